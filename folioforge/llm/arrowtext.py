"""Map whole texts, batch by batch, without leaving Arrow memory.

``annotate`` hands each task's rows to a function as slices of at most about
``CHUNK_BYTES`` of UTF-8 (a longer text is a slice of its own), so the memory
of a task does not depend on the batch size that Spark chose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK_BYTES = 1 << 20


class Chunk:
    """Some consecutive texts: ``data`` (uint8) and ``offsets`` (int64, one more than rows)."""

    def __init__(self, array: pa.Array, extra: dict[str, pa.Array]):
        self.array, self.extra, self.rows = array, extra, len(array)
        _, offsets, data = array.buffers()
        first = np.frombuffer(offsets, dtype=np.int32, count=self.rows + 1, offset=4 * array.offset).astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = raw[first[0] : first[-1]], first - first[0]

    def texts(self) -> list[str]:
        return self.array.to_pylist()


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > CHUNK_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def annotate(
    df: DataFrame,
    text: str,
    out: T.StructType,
    make: Callable[[], Callable[[Chunk], list]],
    keep: list[str],
    also: dict[str, str] | None = None,
) -> DataFrame:
    """Rows of ``df`` as ``row`` (a struct of ``keep``) beside ``out`` (a struct of what ``make()`` returns per chunk).

    A null text counts as empty. ``make`` is called once per task; its result
    takes a Chunk and returns one sequence or Arrow array per field of ``out``.
    ``also`` names further input columns for ``Chunk.extra``. Names cannot
    clash, as the kept columns stay inside their struct.
    """
    also = also or {}
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = df.select(
        F.struct(*[q(c) for c in keep]).alias("row"),
        F.coalesce(q(text).cast("string"), F.lit("")).alias("text"),
        *[q(c).alias(f"x_{k}") for k, c in also.items()],
    )
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("out", out)])
    kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index
            rows, texts = batch.column(at("row")), batch.column(at("text"))
            if not len(texts):
                continue
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
            for lo, hi in _cuts(np.diff(ends)):
                chunk = Chunk(texts.slice(lo, hi - lo), {k: batch.column(at(f"x_{k}")).slice(lo, hi - lo) for k in also})
                made = work(chunk)
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k.type) for x, k in zip(made, kinds, strict=True)]
                arrays = [x if x.type == k.type else x.cast(k.type) for x, k in zip(arrays, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), pa.StructArray.from_arrays(arrays, fields=kinds)], names=["row", "out"])

    return source.mapInArrow(run, schema)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row: the next ``counts[i]`` of ``values``."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

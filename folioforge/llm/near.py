"""Links between near copies, checked against the texts' shingles.

Candidate links come from fingerprints, which err near the limit of similarity.
Here the candidates' groups are read again as texts, and only pairs whose sets
of word shingles have a Jaccard similarity of at least ``LIKE`` stay linked. A
group of up to ``CHUNK`` distinct texts is compared whole. A larger one is dealt
into chunks by hash that all hold its leaders, one of each of ``LEADERS`` hash
classes; a text that finds nobody there is compared with every partner that its
candidate links name. So no text is linked without a pair that was counted, and
no task holds more than a chunk. Only texts in candidate groups are compared;
their shingles are counted in the task, exactly up to 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.bytewords import IS_TEXT, Words, gram_hashes
from folioforge.llm.store import cut

LIKE, CHUNK, LEADERS = 0.8, 256, 16
#: Bytes of text in a chunk, besides its leaders: a word takes about a hundred bytes while a chunk is compared.
CHUNK_BYTES = 2 << 20
#: Bytes of text that are cut into words at a time, and shared shingles that are counted at a time.
_BYTES, _COLUMNS = 1 << 18, 4096


def shingle_rows(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row; a text of fewer words has one, one without words none."""
    rows, hashes, lo = [], [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BYTES):
            size += len(texts[hi])
            hi += 1
        data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
        w = Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]).astype(np.int64), IS_TEXT)
        own = w.hashes()
        grams = gram_hashes(own, shingle)
        row = w.row[: len(grams)]
        inside = row == w.row[shingle - 1 :][: len(grams)]
        short = [(r, gram_hashes(own[w.first[r] : w.first[r + 1]], int(w.counts[r]))[0]) for r in np.flatnonzero((w.counts > 0) & (w.counts < shingle)).tolist()]
        rows += [row[inside] + lo, np.array([r + lo for r, _ in short], dtype=np.int64)]
        hashes += [grams[inside], np.array([h for _, h in short], dtype=np.uint64)]
        lo = hi
    row, h = np.concatenate(rows).astype(np.int32), np.concatenate(hashes)
    del rows, hashes
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    del order
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def similar(texts: list[bytes], shingle: int, like: float) -> np.ndarray:
    """Which pairs of texts have a similarity of at least ``like``."""
    n = len(texts)
    row, h = shingle_rows(texts, shingle)
    size = np.bincount(row, minlength=n)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    on = shared[column]
    row, column = row[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n))
    for lo in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        held = np.zeros((n, _COLUMNS), dtype=np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        both += held @ held.T
    either = size[:, None] + size[None] - both
    return (both >= like * np.maximum(either, 1)) & (size > 0)[:, None] & (size > 0)[None]


def _stars(near: np.ndarray) -> np.ndarray:
    """Of each row the smallest place that it reaches over near pairs."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _compared(keys: int, shingle: int, like: float):
    """Over rows sorted by ``keys`` columns, then fp and text: a link for each row that is near another one of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, texts = None, [], []

        def done() -> pa.RecordBatch:
            label = _stars(similar(texts, shingle, like)) if len(texts) > 1 else np.zeros(len(texts), np.int64)
            at = np.flatnonzero(label != np.arange(len(texts)))
            own = np.array(fps, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[label[at]])], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: keys + 1]]
            body = batch.column(keys + 1).cast(pa.binary())
            for i in range(batch.num_rows):
                key = tuple(c[i] for c in columns[:keys])
                if key != now:
                    if len(texts) > 1:
                        yield done()
                    now, fps, texts = key, [], []
                fps.append(columns[keys][i])
                texts.append(body[i].as_py() or b"")
        if len(texts) > 1:
            yield done()

    return run


def verified(links: DataFrame, found: DataFrame, texts: DataFrame, shingle: int = 5, like: float = LIKE, chunk: int = CHUNK, leaders: int = LEADERS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Of candidate ``links`` (a, b), whose groups are ``found`` (node, root), the links (a, b) that the texts bear out.

    ``texts`` has one row (fp, text) for each node; where texts differ that share a fingerprint, any of them.
    """
    nodes = found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root")).distinct()
    held = cut(nodes.join(texts, "fp"))
    sizes = held.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sized = cut(nodes.join(sizes, "root").withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")))
    wide = sized.where("chunks > 1")
    first = wide.groupBy("root", "chunks", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(leaders)).alias("class")).agg(F.min("fp").alias("fp"))
    everywhere = first.select("root", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    own = sized.select("root", "fp", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
    places = own.unionByName(everywhere).distinct() if not wide.isEmpty() else own
    dealt = places.join(held.select("fp", "text"), "fp").select("root", "chunk", "fp", "text").repartition("root", "chunk").sortWithinPartitions("root", "chunk", "fp")
    near = cut(dealt.mapInArrow(_compared(2, shingle, like), "a long, b long"))
    if wide.isEmpty():
        return near
    linked = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    alone = cut(wide.select("fp").join(linked, "fp", "left_anti"))
    pairs = links.join(alone.withColumnRenamed("fp", "a"), "a", "left_semi").unionByName(links.join(alone.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b")).where("a <> b").distinct()
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp")).join(held.select("fp", "text"), "fp").select("a", "b", "fp", "text")
    asked = sides.repartition("a", "b").sortWithinPartitions("a", "b", "fp")
    return near.unionByName(asked.mapInArrow(_compared(2, shingle, like), "a long, b long"))

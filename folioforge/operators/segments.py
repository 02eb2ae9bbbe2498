"""A catalog that grows by deltas: what a batch writes follows the batch, not the catalog.

The folder holds segments of plain Parquet: a base, and deltas with the changed
rows, their index rows, and the ids they change (``changed``; an id without a
row there is deleted). A version is a small file that lists its segments from
the oldest to the newest with the totals; creating it publishes the batch. At
read the newest segment that changes an id wins: each older row meets the
changed ids of the deltas, and the base's filters still reach its scan.

After a batch, deltas are merged while an older one is smaller than ``RATIO``
times all newer ones together, so their number grows with the logarithm of the
catalog and each row is rewritten about as often. Segments that none of the
newest ``keep`` versions lists are deleted; who has opened one of these reads
on undisturbed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators import index as ix
from folioforge.schema import BOOKS, MISSES
from folioforge.session import together

RATIO = 2.0
#: Tables of a segment: schema and what they are sorted by.
KINDS = {
    "books": (BOOKS, ["category", "author", "id"]),
    "terms": ("id long, term string, weight double, n long", ["term", "id"]),
    "lengths": ("id long, length long", ["id"]),
    "changed": ("id long", ["id"]),
    "misses": (MISSES, ["id"]),
}


@dataclass(frozen=True)
class Segment:
    name: str
    size: int


@dataclass(frozen=True)
class Version:
    segments: tuple[Segment, ...] = ()
    n_rows: int = 0
    n_tokens: int = 0
    last_id: int = 0


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions, oldest first."""
    return store.published(spark, path)


def load(spark: SparkSession, path: str, name: str | None = None) -> Version | None:
    """The named version, or the newest; None if there is none."""
    done = versions(spark, path)
    if not done:
        return None
    raw = json.loads(store.read_marker(spark, path, name or done[-1]))
    return Version(**raw | {"segments": tuple(Segment(**s) for s in raw["segments"])})


def tables(spark: SparkSession, path: str, version: Version) -> dict[str, DataFrame]:
    """books, terms, lengths and misses of a version, and its totals."""
    return _newest(spark, path, version.segments) | {"totals": spark.createDataFrame([(version.n_rows, version.n_tokens)], "n_rows long, n_tokens long")}


def _newest(spark: SparkSession, path: str, segments: tuple[Segment, ...]) -> dict[str, DataFrame]:
    """Of each table the rows that no newer segment changes."""
    out = {}
    for kind, (schema, _) in KINDS.items():
        if kind == "changed":
            continue
        of = lambda s, k: spark.read.schema(KINDS[k][0]).parquet(f"{path}/segments/{s.name}/{k}")
        marks = "misses" if kind == "misses" else "changed"
        rows, after = None, None
        for i, s in enumerate(segments):
            own = of(s, kind).withColumn("segment", F.lit(i))
            rows = own if rows is None else rows.unionByName(own)
            if i:
                ids = of(s, marks).select("id", F.lit(i).alias("at"))
                after = ids if after is None else after.unionByName(ids)
        if rows is None:
            out[kind] = spark.createDataFrame([], schema)
        elif after is None:
            out[kind] = rows.drop("segment")
        else:
            newest = after.groupBy("id").agg(F.max("at").alias("at"))
            out[kind] = rows.join(newest, "id", "left").where(F.col("at").isNull() | (F.col("segment") >= F.col("at"))).select(*[f.name for f in spark.createDataFrame([], schema).schema])
    return out


def _write(spark: SparkSession, path: str, parts: dict[str, DataFrame]) -> Segment:
    """A new segment; the number of files follows the rows' size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``)."""
    name = uuid.uuid4().hex
    put = lambda kind, order: parts[kind].repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/segments/{name}/{kind}")
    together(*[lambda kind=kind, order=order: put(kind, order) for kind, (_, order) in KINDS.items()])
    return Segment(name, store.size_of(spark, f"{path}/segments/{name}"))


def to_merge(sizes: list[int], ratio: float = RATIO) -> int:
    """The first segment to merge with all newer ones; the last one's place where none need be."""
    at, newer = len(sizes) - 1, sizes[-1]
    while at > 0 and sizes[at - 1] < ratio * newer:
        at -= 1
        newer += sizes[at]
    return at


def _publish(spark: SparkSession, path: str, version: Version, keep: int) -> Version:
    done = versions(spark, path)
    name = f"{int(done[-1].split('-')[0]) + 1 if done else 0:012d}-{uuid.uuid4().hex[:8]}"
    store.write_marker(spark, path, name, json.dumps(asdict(version)))
    kept, old = [*done, name][-keep:], [*done, name][:-keep]
    if old:
        live = {s.name for v in kept for s in load(spark, path, v).segments}
        gone = {s.name for v in old for s in load(spark, path, v).segments} - live
        for v in old:
            store.delete(spark, f"{path}/published/{v}")
        for s in sorted(gone):
            store.delete(spark, f"{path}/segments/{s}")
    return version


def append(spark: SparkSession, path: str, books: DataFrame | None = None, deleted: DataFrame | None = None, misses: DataFrame | None = None, last_id: int = 0, keep: int = 3, ratio: float = RATIO) -> Version:
    """Publishes a batch: rows in place of those of their ids, deleted ids (column ``id``; a row of the batch wins),
    and rows of the miss table. Ids are unique in each. A batch that is repeated changes nothing."""
    old = load(spark, path) or Version()
    before = tables(spark, path, old)
    names = [f.name for f in spark.createDataFrame([], BOOKS).schema]
    rows = store.cut((books if books is not None else spark.createDataFrame([], BOOKS)).select(*names))
    changed = rows.select("id") if deleted is None else rows.select("id").unionByName(deleted.select(F.col("id").cast("long"))).distinct()
    fresh = ix.build(rows, once=True)
    segment = _write(spark, path, {"books": rows, "terms": fresh.terms, "lengths": fresh.lengths, "changed": changed, "misses": misses if misses is not None else spark.createDataFrame([], MISSES)})
    own = spark.read.schema(KINDS["changed"][0]).parquet(f"{path}/segments/{segment.name}/changed")
    tokens = lambda df: df.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n_new, t_new, n_old, t_old = together(
        rows.count,
        lambda: tokens(spark.read.schema(KINDS["lengths"][0]).parquet(f"{path}/segments/{segment.name}/lengths")),
        lambda: before["books"].select("id").join(own, "id").count() if old.segments else 0,
        lambda: tokens(before["lengths"].join(own, "id")) if old.segments else 0,
    )
    version = Version((*old.segments, segment), old.n_rows - n_old + n_new, old.n_tokens - t_old + t_new, max(old.last_id, last_id))
    return _publish(spark, path, _merged(spark, path, version, to_merge([s.size for s in version.segments], ratio)), keep)


def _merged(spark: SparkSession, path: str, version: Version, at: int) -> Version:
    """The version with the segments from ``at`` on as one; without older ones the changed ids have done their work."""
    run = version.segments[at:]
    if len(run) < 2:
        return version
    parts = _newest(spark, path, run)
    marks = spark.createDataFrame([], "id long")
    if at:
        for s in run:
            marks = marks.unionByName(spark.read.schema("id long").parquet(f"{path}/segments/{s.name}/changed"))
        marks = marks.distinct()
    merged = _write(spark, path, parts | {"changed": marks})
    return replace(version, segments=(*version.segments[:at], merged))


def compact(spark: SparkSession, path: str, keep: int = 3) -> Version:
    """Publishes the same catalog as one segment."""
    version = load(spark, path)
    return _publish(spark, path, _merged(spark, path, version, 0), keep)

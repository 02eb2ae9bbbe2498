"""Progress reports: one whenever ``every`` seconds have passed since the last one.

Which rows report depends on each report before, so windows of fixed length do
not do. A row points to the first row at least ``every`` later; reports are the
rows reached from the first one. Rows are dealt into stretches of time that are
no shorter than ``every`` and hold about as many rows each. Inside a stretch
the pointers are followed at once for every row where the chain may enter it,
all of which lie in its first ``every`` seconds or just after; between stretches
only these entries are left, and the chain through them is found by pointer
jumping, which doubles its steps each round. Then each stretch is walked from
its one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators.outcomes import counters

#: Most stretches, rows sampled to cut them, and rows aimed at for each, which a task sorts in memory.
STRETCHES, SAMPLED, ROWS = 4096, 200_000, 100_000


def _cuts(moments: DataFrame, every: int, rows: int) -> list[int]:
    """Beginnings of stretches of about ``rows`` moments and at least ``every`` microseconds."""
    n = moments.count()
    wanted = min(STRETCHES, n // rows)
    if wanted < 2:
        return []
    seen = sorted(r.t for r in moments.sample(min(1.0, SAMPLED / n), seed=1).select("t").collect())
    cuts: list[int] = []
    for i in range(1, wanted):
        at = seen[i * len(seen) // wanted]
        if at - (cuts[-1] if cuts else seen[0]) >= every:
            cuts.append(at)
    return cuts


def _part(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or before ``t``."""
    places = np.array(cuts, dtype=np.int64)
    count = lambda t: pa.array(np.searchsorted(places, t.to_numpy(zero_copy_only=False), side="right").astype(np.int32))
    return F.arrow_udf(count, "int")(F.col("t")) if cuts else F.lit(0)


def _chain(t: np.ndarray, every: int) -> np.ndarray:
    """Of each place in the sorted times the first place at least ``every`` later (the length if there is none)."""
    return np.searchsorted(t, t + every, side="left")


def _entries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, t in _stretches(batches):
            after = _chain(t, every)
            last = np.where(after < len(t), after, np.arange(len(t)))
            while not np.array_equal(further := last[last], last):
                last = further
            n = min(int(np.searchsorted(t, t[0] + every, side="left")) + 1, len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, stretch, np.int32)), pa.array(t[:n]), pa.array(t[last[:n]] + every)], names=["stretch", "t", "until"])

    return run


def _walk(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch, t, entry in _stretches(batches, entry=True):
            out, i = [], int(np.searchsorted(t, entry))
            after = _chain(t, every)
            while i < len(t):
                out.append(i)
                i = int(after[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), stretch, np.int32)), pa.array(t[out])], names=["stretch", "t"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch], entry: bool = False) -> Iterator[tuple]:
    """Of a task's rows (stretch, t[, entry]), sorted by both, each stretch with its times."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        stretch, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        extra = batch.column(2).to_numpy(zero_copy_only=False) if entry else None
        begin = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]])) if len(stretch) else []
        for lo, hi in zip(begin, [*begin[1:], len(stretch)], strict=True):
            key = (int(stretch[lo]), int(extra[lo])) if entry else (int(stretch[lo]),)
            if now is not None and key != now:
                yield (now[0], np.concatenate(held), *now[1:])
                held = []
            now = key
            held.append(t[lo:hi])
    if now is not None:
        yield (now[0], np.concatenate(held), *now[1:])


def report_times(moments: DataFrame, every: int, rows: int = ROWS) -> DataFrame:
    """``t`` (microseconds) of the first row and of each one that is the first at least ``every`` after the one before."""
    moments = store.cut(moments.select("t").where("t IS NOT NULL").distinct())
    cuts = _cuts(moments, every, rows)
    dealt = moments.select(_part(cuts).alias("stretch"), "t")
    tasks = len(cuts) + 1
    placed = dealt.repartition(tasks, "stretch").sortWithinPartitions("stretch", "t")
    entries = store.cut(placed.mapInArrow(_entries(every), "stretch int, t long, until long"))
    # each entry's next one: the first from ``until`` on in the next stretch that has rows, or else the first row after that one
    heads = entries.groupBy("stretch").agg(F.min("t").alias("head"))
    by_stretch = Window.orderBy("stretch")  # one row a stretch, few thousand at most
    order = heads.select("stretch", F.lead("stretch").over(by_stretch).alias("into"), F.lead("head", 2).over(by_stretch).alias("beyond")).where("into IS NOT NULL")
    asked = entries.join(F.broadcast(order), "stretch").select(F.col("into").alias("at"), F.col("until").alias("when"), F.col("t").alias("by"), F.lit(0).alias("kind"), "beyond")
    offered = entries.select(F.col("stretch").alias("at"), F.col("t").alias("when"), F.lit(None).cast("long").alias("by"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("beyond"))
    back = Window.partitionBy("at").orderBy(F.desc("when"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(offered).withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("when")), ignorenulls=True).over(back))
    jump = store.cut(met.where("kind = 0").select("by", F.coalesce("next", "beyond").alias("next")).where("next IS NOT NULL"))
    reached = entries.agg(F.min("t").alias("t")).where("t IS NOT NULL")
    for _ in range(max(1, len(cuts)).bit_length() if cuts else 0):
        step = reached.join(jump, reached["t"] == jump["by"]).select(F.col("next").alias("t"))
        reached = store.cut(reached.unionByName(step).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = store.cut(a.join(b, F.col("a.next") == F.col("b.by")).select(F.col("a.by"), F.col("b.next")))
    entered = entries.join(reached, "t").select("stretch", F.col("t").alias("entry"))  # one row a stretch
    walked = dealt.join(F.broadcast(entered), "stretch").select("stretch", "t", "entry").repartition(tasks, "stretch").sortWithinPartitions("stretch", "entry", "t")
    return walked.mapInArrow(_walk(every), "stretch int, t long").select("t")


def progress_reports(outcomes: DataFrame, every: float = 10.0, ts: str = "ts", rows: int = ROWS) -> DataFrame:
    """``ts`` of each report with the running totals of all outcomes up to its time. The first outcome starts the
    clock and is no report; outcomes without a time are in no report.

    Totals are summed between reports first, so one row a report goes through the running sum, by stretches of
    ``rows`` reports with carried totals.
    """
    micros = round(every * 1e6)
    timed = outcomes.withColumn("t", F.unix_micros(F.col(ts).cast("timestamp"))).where("t IS NOT NULL")
    start = timed.agg(F.min("t")).first()[0]
    reports = store.cut(report_times(timed, micros, rows).where(F.col("t") > F.lit(start).cast("long")))
    per = timed.groupBy("t").agg(*counters())
    names = ["found", "missing", "failed", "blocked", "challenged", "processed"]
    both = per.select("t", *names, F.lit(False).alias("report")).unionByName(reports.select("t", *[F.lit(0).cast("long").alias(c) for c in names], F.lit(True).alias("report")))
    cuts = _cuts(reports, 1, rows)
    summed = both.groupBy("t").agg(F.max("report").alias("report"), *[F.sum(c).alias(c) for c in names]).select("*", _part(cuts).alias("part"))
    inside = Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    own = summed.select("part", "t", "report", *[F.sum(c).over(inside).alias(c) for c in names])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.groupBy("part").agg(*[F.sum(c).alias(f"{c}_") for c in names]).select("part", *[F.coalesce(F.sum(f"{c}_").over(before), F.lit(0)).alias(f"{c}_") for c in names])
    return own.where("report").join(F.broadcast(carried), "part").select(F.timestamp_micros("t").cast(outcomes.schema[ts].dataType).alias("ts"), *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names])

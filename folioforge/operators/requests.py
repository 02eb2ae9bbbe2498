"""What a search box sends and shows: trailing debounce, and the guard against answers to older requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(typed: DataFrame, wait: str = "90 milliseconds", by: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Of each burst of a user the last row, in its own columns: a burst ends when ``wait`` passes without another.

    Bursts are session windows, so the same plan serves a stream (with a watermark, one row when a burst is over)
    and a table; the last row is a partial aggregate, so a busy user's rows are combined before they meet. Rows
    without a time are in no burst; rows of no user share one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in typed.columns])
    last = typed.groupBy(F.session_window(ts, wait).alias("burst"), F.col(by).alias("who")).agg(F.max_by(row, F.struct(ts, order)).alias("row"))
    return last.select("row.*")


def stream_debounce(typed: DataFrame, wait: str = "90 milliseconds", late: str = "10 seconds", by: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """``debounce`` of a stream: rows that come later than ``late`` behind the newest are dropped."""
    return debounce(typed.withWatermark(ts, late), wait, by, ts, order)


def newest_before(requests: DataFrame, answers: DataFrame, by: str, stretch: int = 3600) -> DataFrame:
    """``answers`` (``by``, ``at``, further columns) with ``newest``, the request (``by``, ``at``, ``request``) last made
    at or before each, null if none.

    Both are sorted together, so no pairs are made. Stretches of ``stretch`` seconds are windowed apart, and the
    newest request before each goes through one row a stretch, so a busy user is not one task.
    """
    extra = [c for c in answers.columns if c not in (by, "at")]
    asked = requests.select(F.col(by).alias("who"), "at", F.lit(0).alias("kind"), F.col("request").alias("asked"), *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in extra])
    given = answers.select(F.col(by).alias("who"), "at", F.lit(1).alias("kind"), F.lit(None).cast(requests.schema["request"].dataType).alias("asked"), *extra)
    rows = asked.unionByName(given).withColumn("stretch", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (stretch * 1_000_000)))
    # of requests made at one time the largest is the newest; requests come before answers of their time
    inside = Window.partitionBy("who", "stretch").orderBy("at", "kind", "asked").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("here", F.last("asked", ignorenulls=True).over(inside))
    ends = rows.where("kind = 0").groupBy("who", "stretch").agg(F.max_by("asked", F.struct("at", "asked")).alias("last"))
    held = ends.unionByName(rows.where("kind = 1").select("who", "stretch").distinct().withColumn("last", F.lit(None).cast(requests.schema["request"].dataType)))
    each = held.groupBy("who", "stretch").agg(F.max("last").alias("last"))
    carried = each.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("who").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    met = own.where("kind = 1").join(carried.select(F.col("who").alias("w"), F.col("stretch").alias("s"), "before"), F.col("who").eqNullSafe(F.col("w")) & F.col("stretch").eqNullSafe(F.col("s")), "left")
    return met.select(F.col("who").alias(by), "at", *extra, F.coalesce("here", "before").alias("newest"))


def stale_guard(requests: DataFrame, answers: DataFrame, by: str = "user_id", stretch: int = 3600) -> DataFrame:
    """``answers`` (with ``request``, what they answer) with ``newest`` and ``shown``: whether no newer request was
    made before they came."""
    return newest_before(requests, answers, by, stretch).withColumn("shown", F.coalesce(F.col("newest") == F.col("request"), F.lit(False)))

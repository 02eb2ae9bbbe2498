"""Upserts, checkpoints and compaction on Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import store
from folioforge.schema import GAPS


def last_write_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Of each key the row of the highest ``order``; a partial aggregate, so no group has to meet in one task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(order, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``old`` with the keys of ``new`` replaced by their latest row (``order`` is dropped)."""
    latest = last_write_wins(new, key, order).drop(order)
    return old.join(latest.select(key), key, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def misses(outcomes: DataFrame) -> DataFrame:
    """Confirmed gaps of an outcome log as rows of the miss table; no reason means http-404."""
    reason = F.coalesce("reason", F.lit("http-404"))
    return outcomes.where(reason.isin(*GAPS)).select("id", "seq", reason.alias("reason"), F.current_timestamp().alias("seen_at"))


def upsert_misses(old: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The miss table with the log's confirmed gaps in place of older rows. Ids that are catalogued stay in it."""
    return upsert(old, misses(outcomes))


def miss_totals(table: DataFrame) -> DataFrame:
    """Rows of the miss table by reason, ties by name, under a row for all."""
    by = table.groupBy("reason").agg(F.count("*").alias("n"))
    return table.agg(F.lit("").alias("reason"), F.count("*").alias("n")).unionByName(by)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps. The old table is deleted only when the new one is in its place; where
    a move fails, the old one is moved back and the error raised."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = f"{path}_{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if not store.exists(spark, path):
        store.rename(spark, fresh, path)
        return
    store.rename(spark, path, f"{fresh}_old")
    try:
        store.rename(spark, fresh, path)
    except Exception:
        store.rename(spark, f"{fresh}_old", path)
        raise
    store.delete(spark, f"{fresh}_old")


def set_checkpoint(spark: SparkSession, path: str, value: int, key: str = "last_id") -> None:
    replace_table(spark.createDataFrame([(key, str(value))], "key string, value string").coalesce(1), path)


def get_checkpoint(spark: SparkSession, path: str, key: str = "last_id", default: int = 0) -> int:
    rows = spark.read.parquet(path).where(F.col("key") == key).select(F.col("value").try_cast("long").alias("v")).head(1)
    return rows[0].v if rows and rows[0].v is not None else default


def compact(df: DataFrame, path: str, files: int, by: str | Column = "id") -> None:
    """Rewrite in key order, which keeps row group statistics narrow."""
    replace_table(df.repartitionByRange(files, by).sortWithinPartitions(by), path)


def at_place(rows: DataFrame, column: str, place: int, parts: int = 1024) -> int | None:
    """The whole number that stands at a place (from 0) in the order of the column; None beyond its end.

    Ranges are counted and narrowed: each round one pass gives at most ``parts`` counts, whatever the number of rows.
    """
    own = rows.select(F.col(column).cast("decimal(20,0)").alias("v")).where("v IS NOT NULL")
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not 0 <= place < n:
        return None
    low, high = int(low), int(high)
    while low < high:
        width = (high - low) // parts + 1
        step = F.floor((F.col("v") - F.lit(low)) / F.lit(width)) if width > 1 else F.col("v") - F.lit(low)
        counts = own.where(F.col("v").between(low, high)).groupBy(step.cast("long").alias("k")).count().collect()
        for k, count in sorted(map(tuple, counts)):
            if place < count:
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
                break
            place -= count
    return low

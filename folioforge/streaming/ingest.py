"""The ingest operators over streams: progress windows and loading; ordered folds are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators import segments as sg
from folioforge.operators import writes as wr
from folioforge.operators.catalog import Catalog
from folioforge.operators.outcomes import counters
from folioforge.sources.responses import ParseProfile, classify


def stream_progress(outcomes: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Conditional totals per tumbling window; rows later than the watermark are dropped."""
    out = outcomes.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(*counters())
    return out.select(F.col("w.start").alias("window_start"), "found", "missing", "failed", "blocked", "challenged", "processed")


def apply_batch(responses: DataFrame, path: str, number: int, profile: ParseProfile | None = None) -> Catalog:
    """Classifies captured responses and publishes books, index, misses and high-water mark as one delta.

    A batch that is repeated changes nothing; one that fails leaves the old version current. What is written
    follows the batch (``segments``). A book that is found keeps its row among the misses, and the reverse.
    """
    spark = responses.sparkSession
    seen = store.cut(classify(responses, profile).select("id", "reason", "book", F.lit(number).alias("seq")))
    books = wr.last_write_wins(seen.where("book IS NOT NULL").select("book.*", F.lit("captured").alias("source"), "seq")).drop("seq")
    misses = wr.last_write_wins(wr.misses(seen)).drop("seq")
    high = seen.agg(F.max("id")).first()[0]
    sg.append(spark, path, books, misses=misses, last_id=high or 0)
    return Catalog.open(spark, path)


def load(responses: DataFrame, path: str, checkpoint: str, profile: ParseProfile | None = None):
    """Starts a stream of captured responses into the catalog at ``path``, one delta per micro-batch."""
    return responses.writeStream.foreachBatch(lambda df, number: apply_batch(df, path, number, profile)).option("checkpointLocation", checkpoint).start()

"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioforge.store import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and executors may be lost.

    The tables stay until ``clear`` is called, as results that are not yet computed may read them.
    """
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the table's path, for whoever deletes it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all runs in the shared folder; call it when no result is pending."""
    from folioforge.store import delete

    delete(spark, f"{shared_dir(spark).rstrip('/')}/tables")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Shared folders and published table versions."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary one, for local
    sessions only: other executors could not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder to a name that is free, or fails."""
    (a, fs), (b, _) = _path(spark, source), _path(spark, target)
    if fs.exists(b) or not fs.rename(a, b):
        raise OSError(f"could not move {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files below the path, as one hash: another one where a table was rewritten."""
    where, fs = _path(spark, path)
    seen, files = hashlib.sha256(), fs.listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for line in sorted(found):
        seen.update(line.encode())
    return seen.hexdigest()


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below the path."""
    where, fs = _path(spark, path)
    return fs.getContentSummary(where).getLength()


def write_marker(spark: SparkSession, path: str, name: str, text: str) -> None:
    """Publishes a version: its marker appears whole, by one move, and only if the name is free."""
    fresh = f"{path}/unpublished/{uuid.uuid4().hex}"
    where, fs = _path(spark, fresh)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()
    folder, _ = _path(spark, f"{path}/published")
    fs.mkdirs(folder)
    rename(spark, fresh, f"{path}/published/{name}")


def read_marker(spark: SparkSession, path: str, name: str) -> str:
    rows = spark.read.text(f"{path}/published/{name}", wholetext=True).collect()
    return rows[0].value if rows else ""


def published(spark: SparkSession, path: str) -> list[str]:
    """Published versions, oldest first: those whose marker file exists."""
    where, fs = _path(spark, f"{path}/published")
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest published version."""
    done = published(spark, path)
    return f"{path}/versions/{done[-1]}" if done else None


def publish(tables: dict[str, DataFrame], path: str, keep: int = 2, prepare=None, options: dict[str, dict] | None = None) -> str:
    """Writes the tables as a new version and makes all of them current at once, by creating one marker file.

    Readers see the old version or the new one, never a mix; a failed write leaves the old one current.
    ``prepare`` may write more into the version's folder; ``options`` are Parquet options by table. Versions beyond the newest ``keep`` are deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    done = published(spark, path)
    name = f"{int(done[-1].split('-')[0]) + 1 if done else 0:012d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{name}"
    for table, df in tables.items():
        df.write.options(**(options or {}).get(table, {})).parquet(f"{folder}/{table}")
    if prepare:
        prepare(folder)
    where, fs = _path(spark, f"{path}/published/{name}")
    fs.create(where, False).close()
    for old in [*done, name][:-keep]:
        delete(spark, f"{path}/published/{old}")
        delete(spark, f"{path}/versions/{old}")
    return folder


def cut(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Writes ``df`` to ``path`` or below the shared folder and reads it back, so that later jobs do not run it again."""
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables, catalogs, captures and streams that queries left in the shared folder; call it when no
    result is pending."""
    for name in ("tables", "catalogs", "captures", "streams"):
        delete(spark, f"{shared_dir(spark).rstrip('/')}/{name}")

"""Sessions for tests and benchmarks, and the package's way to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the package's own tests and benchmark use."""
    path = os.environ.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioforge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def together(*jobs: Callable[[], object]) -> list:
    """Results of jobs that do not wait for each other; small ones leave room for others' tasks."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file to the executors, once per application, unless their path has it."""
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="folioforge-"), "folioforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "folioforge")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _sent.add(spark.sparkContext.applicationId)

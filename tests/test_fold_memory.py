"""NFKC over whole tables: what a Python worker is given and holds."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.functions import text as tx

TEXTS = ["ﬁn ½ Å é", "plain", "", None, "e\u0301", "日本ｶﾞ", "\u05e9\ufb2a", "\U0001d400 x"]


def test_results_leave_in_small_batches():
    batch = pa.array([f"{'déjà vu ﬁn ' * 200}{i}" for i in range(10_000)])
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    began, most, rows = pa.total_allocated_bytes(), 0, 0
    for some in tx._flowing(nfkc)(iter([batch])):
        assert some.to_pylist() == [nfkc(x) for x in batch.slice(rows, len(some)).to_pylist()]
        rows += len(some)
        most = max(most, pa.total_allocated_bytes() - began)
    assert rows == len(batch) and batch.nbytes > 20e6 and most < 5e6


def test_few_long_texts_are_held_at_a_time():
    texts = ["é" * 400_000, None, "a", "b" * 900_000, "ü" * 3_000_000, "", "c"]
    pieces = list(tx._pieces(pa.array(texts)))
    assert sum(pieces, []) == texts
    assert [len(x) for x in pieces] == [3, 1, 1, 2]
    assert list(tx._pieces(pa.array([], pa.string()))) == []


def test_nfkc_with_and_without_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(3)
    got = {r.i: r.n for r in df.select("i", tx.nfkc(F.col("text")).alias("n")).collect()}
    assert got == {i: x if x is None else unicodedata.normalize("NFKC", x) for i, x in enumerate(TEXTS)}
    assert df.where("i < 0").select(tx.nfkc(F.col("text"))).collect() == []


def test_ascii_texts_are_not_sent_to_python(spark):
    df = spark.createDataFrame([("plain",), ("é",)], "text string")
    plan = df.select(tx.normalize(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert "octet_length" in next(x for x in plan.splitlines() if "ArrowEvalPython [" in x)

"""Which rows may match a set of keys: none is lost, few others come along, and only those rows' texts are shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import simhash


@pytest.mark.parametrize(("n", "most"), [(0, 1 << 27), (1, 1 << 27), (9000, 1 << 27), (9000, 1 << 15)])
def test_no_row_with_a_key_is_lost(spark, monkeypatch, n, most):
    monkeypatch.setattr(simhash, "MOST_BITS", most)
    rows = spark.range(30_000).select("id", F.xxhash64("id").alias("h0"))
    told = simhash._perhaps(rows, rows.where(F.col("id") < n)).groupBy((F.col("id") < n).alias("own"), "perhaps").count().collect()
    of = {(r.own, r.perhaps): r["count"] for r in told}
    assert of.get((True, True), 0) == n and (True, False) not in of
    assert of.get((False, True), 0) <= 0.1 * 30_000 * (3 if most == 1 << 15 else 1) and sum(of.values()) == 30_000


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_texts_that_stay_are_not_shuffled(spark):
    """Beyond the size that Spark broadcasts by itself, as on any large input."""
    r = random.Random(5)
    rows = [(i, " ".join("w%d" % r.randrange(10**6) for _ in range(60))) for i in range(3000)]
    rows += [(i + 3000, rows[i][1] + " more") for i in range(150)]
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    held = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        docs = simhash.cut(spark.createDataFrame(rows, "doc_id long, text string"))
        kept = simhash.deduplicate(docs, wide=simhash.Wide())
        assert sorted(x.doc_id for x in kept.collect()) == list(range(3000))
        moved = [n for n in _nodes(kept._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
        written = sum(n.metrics().apply("shuffleRecordsWritten").value() for n in moved)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert 150 <= written < 1500

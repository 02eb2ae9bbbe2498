"""Reports over many moments: a stretch, which one task sorts, stays small whatever the table's size."""

from pyspark.sql import functions as F

from folioforge.operators import reports as rp


def test_default_stretches_are_small(spark, monkeypatch):
    seen, own = [], rp._cuts
    monkeypatch.setattr(rp, "_cuts", lambda *how: seen.append(own(*how)) or seen[-1])
    moments = spark.range(300_000).select((F.col("id") * 1_000_000).alias("t"))
    assert rp.report_times(moments, 2_000_000).agg(F.count("*"), F.sum("t")).first()[:] == (150_000, 150_000 * 149_999 * 1_000_000)
    assert len(seen[0]) == 2

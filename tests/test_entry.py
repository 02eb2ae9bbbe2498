import __spark_entry__ as e


def test_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

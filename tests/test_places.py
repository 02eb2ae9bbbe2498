"""Values at places, without the rows before them on the driver."""

import random

import pytest

from folioforge.operators import writes as wr


@pytest.mark.parametrize("span", [3, 50, 1 << 40, 1 << 62])
def test_values_at_places(spark, span):
    r = random.Random(span)
    values = [r.randrange(-span, span) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for place in (0, 1, 66, 133, 199):
        assert wr.at_place(df, "v", place, 8 if span < 1 << 30 else 1024) == sorted(values)[place]
    assert wr.at_place(df, "v", 200) is None

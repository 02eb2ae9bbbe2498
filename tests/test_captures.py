"""WARC captures by byte ranges, and many patterns in one pass."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions.patterns import first_of
from folioforge.sources import captures as cp
from folioforge.sources import responses as rs

SCHEMA = "id long, attempt int, status int, headers map<string,string>, body binary, error string"


@pytest.fixture(scope="module")
def rows():
    r, out = random.Random(3), []
    for i in range(60):
        body = bytes(r.randrange(256) for _ in range(r.choice([0, 5, 900])))
        if i % 7 == 0:
            body += b"\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nnot a record"
        status = r.choice([200, 404, None])
        out.append((i, i % 3, status, {"content-type": "text/html", "x": "a\r\nb: c"} if i % 2 else {}, bytearray(body) or None, "read timeout" if status is None else None))
    return out


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_ranges_read_each_record_once(spark, tmp_path, rows, split):
    df = spark.createDataFrame(rows, SCHEMA)
    cp.write_captures(df.repartition(3), f"{tmp_path}/w")
    back = cp.read_captures(spark, f"{tmp_path}/w", split)
    got = sorted((x.id, x.attempt, x.status, x.headers, x.body and bytes(x.body), x.error) for x in back.collect())
    clean = lambda h: {k: v.replace("\r", " ").replace("\n", " ") for k, v in h.items()}
    assert got == [(i, a, s, clean(h), b and bytes(b), e) for i, a, s, h, b, e in rows]
    assert (back.rdd.getNumPartitions() > 20) == (split <= 1000)
    some = back.where("status = 404 AND id < 30")
    assert {x.id for x in some.collect()} == {x[0] for x in rows if x[2] == 404 and x[0] < 30}


def test_captures_classify_as_their_rows(spark, tmp_path, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), F.lit(0).alias("attempt"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.col("html").cast("binary").alias("body"), F.lit(None).cast("string").alias("error"))
    cp.write_captures(pages, f"{tmp_path}/w")
    kinds = lambda df: sorted((x.id, x.reason, x.detail) for x in rs.classify(df).collect())
    assert kinds(cp.read_captures(spark, f"{tmp_path}/w", 5000)) == kinds(pages)


def test_first_pattern_equals_a_loop(spark):
    r = random.Random(8)
    patterns = ["".join(r.choice("ab") for _ in range(r.randrange(1, 6))) for _ in range(40)]
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    want = lambda ps: {i: None if t is None else next((k for k, p in enumerate(ps) if p in t), None) for i, t in enumerate(texts)}
    for ps in (patterns, patterns[:3], [], ["zz", ""]):
        assert {x.id: x.place for x in first_of(df, "text", ps).collect()} == want(ps)
    markers = first_of(df, "text", rs.BLOCK_MARKERS)
    assert markers.where("place IS NOT NULL").count() == 0


def test_time_does_not_follow_the_number_of_patterns(spark):
    df = spark.range(2000).select(F.expr("repeat(md5(cast(id as string)), 60)").alias("text"))

    def seconds(n):
        ps = ["%012x" % (i * 7919) for i in range(n)]
        first_of(df, "text", ps).agg(F.sum("place")).collect()
        began = time.time()
        first_of(df, "text", ps).agg(F.sum("place")).collect()
        return time.time() - began

    assert seconds(20_000) < 10 * seconds(20) + 3

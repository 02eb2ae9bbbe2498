"""Reports, debounce and the stale guard against plain loops; ordered folds over shuffled late streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.operators import outcomes as oc
from folioforge.operators import reports as rp
from folioforge.operators import requests as rq
from folioforge.schema import HARD
from folioforge.streaming import ordered

START = datetime(2024, 1, 1)


def log(spark, seed, n, spread):
    r, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0.0, 0.01, r.random() * spread])
        rows.append((i, i, r.choice(["ok", "http-403", "http-404"]), START + timedelta(microseconds=round(t * 1e6))))
    return rows, spark.createDataFrame(rows, "seq long, id long, reason string, ts timestamp")


@pytest.mark.parametrize(("spread", "rows"), [(3.0, 10), (0.05, 20), (60.0, 50), (8.0, 10**6)])
def test_reports_equal_a_loop(spark, spread, rows):
    plain, df = log(spark, rows, 600, spread)
    last, wanted = plain[0][3], []
    for _, _, _, ts in plain:
        if (ts - last).total_seconds() >= 10 and ts != last:
            upto = [x for x in plain if x[3] <= ts]
            wanted.append((ts, sum(x[2] == "ok" for x in upto), sum(x[2] in HARD for x in upto), len(upto)))
            last = ts
    got = [(x.ts, x.found, x.failed, x.processed) for x in rp.progress_reports(df, 10.0, rows=rows).orderBy("ts").collect()]
    assert got == wanted
    assert rp.progress_reports(df.where("false"), 10.0).count() == 0
    odd = df.limit(1).unionByName(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    assert rp.progress_reports(odd, 10.0).count() == 0


def test_debounce_and_its_stream(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.randrange(4), START + timedelta(milliseconds=r.randrange(60_000)), f"q{i}") for i in range(800)] + [(9000, None, START, "none"), (9001, 1, None, "no time")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, window string")
    wanted = set()
    for user in (0, 1, 2, 3, None):
        own = sorted((x for x in rows if x[1] == user and x[2]), key=lambda x: (x[2], x[0]))
        wanted |= {x[0] for x, y in zip(own, [*own[1:], None], strict=True) if y is None or y[2] - x[2] >= timedelta(milliseconds=90)}
    got = rq.debounce(df)
    assert {x.event_id for x in got.collect()} == wanted and got.columns == df.columns
    # the stream: shuffled within the lateness, then a row that closes all bursts, then one that is too late
    timed = sorted((x for x in rows if x[2] and x[1] is not None), key=lambda x: x[2])
    jumbled = sorted(timed, key=lambda x: x[2] + timedelta(seconds=r.random() * 4))
    for k, part in enumerate([jumbled[:300], jumbled[300:], [(10_000, 9, START + timedelta(hours=1), "end")], [(10_001, 0, START + timedelta(seconds=1), "late"), (10_002, 9, START + timedelta(hours=2), "end")]]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = rq.stream_debounce(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/p").start()
    q.processAllAvailable()
    q.stop()
    seen = {x.event_id for x in spark.table("bursts").collect()}
    assert {x for x in wanted if x < 9000} <= seen and 10_001 not in seen


@pytest.mark.parametrize("stretch", [1, 7, 3600])
def test_stale_guard_equals_a_loop(spark, stretch):
    r = random.Random(stretch)
    asked = [(r.choice([1, 2, None]), START + timedelta(seconds=r.randrange(60)), i) for i in range(120)]
    came = [(u, at + timedelta(seconds=r.randrange(5)), i) for u, at, i in asked] + [(7, START, 999)]
    got = rq.stale_guard(spark.createDataFrame(asked, "user_id long, at timestamp, request long"), spark.createDataFrame(came, "user_id long, at timestamp, request long"), stretch=stretch)
    wanted = {}
    for u, at, i in came:
        before = [(t, k) for w, t, k in asked if w == u and t <= at]
        newest = max(before)[1] if before else None
        wanted[i] = (newest, newest == i)
    assert {x.request: (x.newest, x.shown) for x in got.collect()} == wanted


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_one_delay_for_all_workers(spark, chunk):
    r, delay, rows = random.Random(chunk), 0.15, []
    for i in range(500):
        reason, wait = r.choice(["ok", "ok", "ok", "http-403", "http-429"]), r.choice([None, None, 3.0])
        rows.append((i, "w%d" % r.randrange(5), reason, wait))
        delay = (min(8.0, max(delay, wait)) if wait is not None else min(8.0, max(0.25, 2 * delay))) if reason != "ok" else max(0.15, delay * 0.9)
    r.shuffle(rows)
    got = oc.throttle(spark.createDataFrame(rows, "seq long, worker string, reason string, wait double"), by=None, chunk_rows=chunk)
    assert got.first().delay == pytest.approx(delay) and got.count() == 1


def test_late_streams_equal_the_batch(spark, tmp_path):
    ordered.rocksdb(spark)
    r = random.Random(5)
    rows = [("a", i, "http-403" if r.random() < 0.75 else "ok", START + timedelta(seconds=i), None) for i in range(200)]
    rows += [("b", i, "ok", START + timedelta(seconds=i), None) for i in range(50)]
    schema = "run string, seq long, reason string, ts timestamp, wait double"
    jumbled = sorted(rows, key=lambda x: x[3] + timedelta(seconds=r.random() * 30))
    end = [(run, 10_000, "ok", START + timedelta(hours=1), None) for run in "ab"]
    for k, part in enumerate([jumbled[:80], jumbled[80:], end, [("a", 10_001, "ok", START + timedelta(hours=3), None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for frame, name in ((ordered.stream_breaker(stream, 9), "trips"), (ordered.stream_throttle(stream), "delays")):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    own = spark.createDataFrame([x for x in rows if x[0] == "a"], schema).withColumn("id", F.col("seq"))
    trip = oc.trip(own, threshold=9).first()
    assert [(x.run, x.seq, x.seen, x.hard, x.consecutive) for x in spark.table("trips").collect()] == [("a", trip.seq, trip.seen, trip.hard, trip.consecutive)]
    delays = [x for x in spark.table("delays").orderBy("seq").collect() if x.run == "a" and x.seq < 10_000]
    assert delays[-1].delay == pytest.approx(oc.throttle(own, by=None).first().delay)
    assert not [x for x in spark.table("delays").collect() if x.run == "b"]

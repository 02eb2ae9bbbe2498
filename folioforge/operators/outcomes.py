"""Ingest accounting over the outcome log (seq order = arrival order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.text import retry_after, retry_delay
from folioforge.schema import GAPS, HARD, REFUSED


def counters() -> list[Column]:
    """The conditional totals, for any aggregation of outcomes."""
    of = lambda *r: F.count_if(F.col("reason").isin(*r))
    return [of("ok").alias("found"), of(*GAPS).alias("missing"), of(*HARD).alias("failed"), of(*REFUSED).alias("blocked"), of("challenge").alias("challenged"), F.count("*").alias("processed")]


def summary(outcomes: DataFrame) -> DataFrame:
    """Reasons by count, ties by first appearance, with their share in percent."""
    n = outcomes.groupBy("reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all_n")))).select("reason", "n", (100.0 * F.col("n") / F.col("all_n")).alias("share"), "first_seq").orderBy(F.desc("n"), "first_seq")


def totals(outcomes: DataFrame, elapsed: float | None = None) -> DataFrame:
    rate = F.lit(None).cast("double") if elapsed is None else F.lit(0.0) if elapsed <= 0 else F.col("processed") / elapsed
    return outcomes.agg(*counters(), F.max("id").alias("high_water")).withColumn("rate", rate)


def verdict(outcomes: DataFrame, aborted: bool = False) -> DataFrame:
    """The exit code of a run: aborted 2, nothing found 3, challenged 5, over a quarter refused 4, else 0."""
    t = outcomes.agg(*counters())
    code = F.when(F.lit(aborted), 2).when((F.col("processed") > 0) & (F.col("found") == 0), 3).when(F.col("challenged") > 0, 5).when(F.coalesce(F.try_divide("blocked", "processed"), F.lit(0.0)) > 0.25, 4).otherwise(0)
    return t.withColumn("exit_code", code)


def samples(outcomes: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` outcomes of each reason but ok: bounded lists meet, not whole groups."""
    bad = outcomes.where("reason <> 'ok'").select("reason", F.struct("seq", "id", "detail").alias("x"))
    part = bad.withColumn("p", F.spark_partition_id()).withColumn("rn", F.row_number().over(Window.partitionBy("reason", "p").orderBy("x"))).where(F.col("rn") <= k)
    return part.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy("x"))).where(F.col("place") <= k).select("reason", "place", "x.seq", "x.id", "x.detail")


def known_ids(books: DataFrame, misses: DataFrame) -> DataFrame:
    """Ids that need no fetch: catalogued, or confirmed gaps."""
    return books.select("id").union(misses.where(F.col("reason").isin(*GAPS)).select("id")).distinct()


def pending_ids(spark: SparkSession, start: int, end: int, known: DataFrame, legacy_checkpoint: int | None = None) -> DataFrame:
    """Ids of the range still to fetch. ``legacy_checkpoint`` starts at that high-water mark instead, so that
    failed ids below it are not retried."""
    low = start if legacy_checkpoint is None else max(start, legacy_checkpoint)
    return spark.range(low, end + 1).join(known, "id", "left_anti")


def breaker(outcomes: DataFrame, threshold: int = 25, sample: int = 60, chunk_rows: int = 100_000) -> DataFrame:
    """Each outcome with seen, found, hard, consecutive and tripped (by itself).

    Running counts over one global order, without one global window: rows are
    windowed inside chunks of ``chunk_rows`` sequence numbers, and only one
    summary row per chunk goes through the window that carries counts over.
    """
    rows = outcomes.select("seq", "id", "reason", F.col("reason").isin(*HARD).cast("int").alias("h"), (F.col("reason") == "ok").cast("int").alias("k"), F.expr(f"seq div {chunk_rows}").alias("chunk"))
    inside = Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.count("*").over(inside).alias("n_in"), F.sum("h").over(inside).alias("h_in"), F.sum("k").over(inside).alias("k_in"))
    rows = rows.withColumn("soft", F.col("n_in") - F.col("h_in"))
    run = Window.partitionBy("chunk", "soft").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("h").over(run))
    sums = rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("h").alias("hs"), F.sum("k").alias("ks"), F.max_by("run", "seq").alias("tail"))
    order = Window.orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("all_hard", F.col("n") == F.col("hs")).withColumn("island", F.sum((~F.col("all_hard")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.sum(F.when(F.col("all_hard"), F.col("n")).otherwise(F.col("tail"))).over(Window.partitionBy("island").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("end_run", carried)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("chunk", zero(F.sum("n").over(before)).alias("n0"), zero(F.sum("hs").over(before)).alias("h0"), zero(F.sum("ks").over(before)).alias("k0"), zero(F.lag("end_run").over(order)).alias("carry"))
    out = rows.join(sums, "chunk").select(
        "seq", "id", "reason",
        (F.col("n0") + F.col("n_in")).alias("seen"), (F.col("k0") + F.col("k_in")).alias("found"), (F.col("h0") + F.col("h_in")).alias("hard"),
        F.when(F.col("h") == 0, 0).otherwise(F.col("run") + F.when(F.col("soft") == 0, F.col("carry")).otherwise(0)).alias("consecutive"),
    )
    trips = (F.col("consecutive") >= threshold) | ((F.col("seen") >= sample) & (F.col("found") == 0) & (F.col("hard") / F.col("seen") > 0.8))
    return out.withColumn("tripped", trips)


def trip(outcomes: DataFrame, **how) -> DataFrame:
    """The outcome that trips the breaker: one row, or none."""
    return breaker(outcomes, **how).where("tripped").orderBy("seq").limit(1)


def accepted(outcomes: DataFrame, **how) -> DataFrame:
    """Outcomes up to the trip; later ones are discarded."""
    last = trip(outcomes, **how).agg(F.min("seq").alias("last_seq"))
    return outcomes.crossJoin(F.broadcast(last)).where("last_seq IS NULL OR seq <= last_seq").drop("last_seq")


def throttle(outcomes: DataFrame, base: float = 0.15, most: float = 8.0, chunk_rows: int = 100_000, by: str | None = "worker") -> DataFrame:
    """The delay after the last outcome, of each ``by`` or (None) of all workers together, where a refusal seen by
    one slows all: refusals double it within bounds, or raise it to the seconds that the server asked for
    (``wait`` column, if there is one and it is not null); others let it fall by a tenth to the base.

    An ordered fold without the whole log in one place: each outcome clamps a multiple of the delay,
    d -> min(hi, max(lo, m d)), and so does any run of them. Chunks of ``chunk_rows`` sequence numbers are folded
    to one such (m, lo, hi) each, runs of ``chunk_rows`` chunks again, and only these are put in order.
    """
    keys = [] if by is None else [by]
    if base > most:  # the first refusal sets the delay for good
        return outcomes.groupBy(*keys).agg(F.when(F.max(F.coalesce(F.col("reason").isin(*REFUSED), F.lit(False))), F.lit(float(most))).otherwise(F.lit(float(base))).alias("delay"))
    wait = F.col("wait").cast("double") if "wait" in outcomes.columns else F.lit(None).cast("double")
    number = lambda x: F.lit(float(x))
    triple = lambda m, lo, hi: F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"))
    bound = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))

    def step(d: Column, x: Column) -> Column:
        refused = x["reason"].isin(*REFUSED)
        m = F.when(refused & x["wait"].isNotNull(), 1.0).when(refused, 2.0).otherwise(0.9)
        lo = F.when(refused, F.least(number(most), F.coalesce(x["wait"], number(0.25)))).otherwise(number(base))
        hi = F.when(refused, number(most)).otherwise(number("inf"))
        # beyond 1e100 either way the bounds decide
        return triple(bound(d["m"] * m, number(1e-100), number(1e100)), bound(d["lo"] * m, lo, hi), bound(d["hi"] * m, lo, hi))

    def after(d: Column, x: Column) -> Column:
        m, lo, hi = x["f"]["m"], x["f"]["lo"], x["f"]["hi"]
        return triple(bound(d["m"] * m, number(1e-100), number(1e100)), bound(d["lo"] * m, lo, hi), bound(d["hi"] * m, lo, hi))

    none = triple(number(1), number(0), number("inf"))
    chunks = outcomes.groupBy(*keys, F.expr(f"seq div {chunk_rows}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("seq", "reason", wait.alias("wait")))).alias("log"))
    folded = chunks.select(*keys, "chunk", F.aggregate("log", none, step).alias("f"))
    runs = folded.groupBy(*keys, F.expr(f"chunk div {max(2, chunk_rows)}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("log")).select(*keys, "run", F.aggregate("log", none, after).alias("f"))
    order = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "f"))).alias("log"))
    return order.select(*keys, F.aggregate("log", number(base), lambda d, x: bound(d * x["f"]["m"], x["f"]["lo"], x["f"]["hi"])).alias("delay"))


def retry_plan(attempts: DataFrame, most: int = 3) -> DataFrame:
    """id, attempt, status and ``wait``: seconds before the next attempt; null where none follows.

    Refusals for pace (429) wait as the server says, refusals (403), server errors and failures without a status
    by their own schedules; other statuses, and the last of ``most`` attempts, are final.
    """
    status, attempt = F.col("status"), F.col("attempt")
    again = status.isNull() | status.isin(403, 429) | (status >= 500)
    wait = F.when(status == 429, retry_after(F.element_at("headers", "retry-after"))).otherwise(retry_delay(F.coalesce(status, F.lit(500)), attempt))
    return attempts.select("id", "attempt", "status", F.when(again & (attempt < most - 1), wait).alias("wait"))


def report(outcomes: DataFrame) -> DataFrame:
    """The summary as lines of text: place, line (reason, count with thousands marks, share)."""
    s = summary(outcomes).select("*", F.row_number().over(Window.orderBy(F.desc("n"), "first_seq")).alias("place"))  # one row per reason
    return s.select("place", F.format_string("%-14s %12s %6.1f%%", "reason", F.format_number("n", 0), "share").alias("line"))


def progress(outcomes: DataFrame, ts: str = "ts", every: str = "10 seconds") -> DataFrame:
    """The conditional totals per tumbling window."""
    return outcomes.groupBy(F.window(ts, every).alias("w")).agg(*counters()).select(F.col("w.start").alias("window_start"), *["found", "missing", "failed", "blocked", "challenged", "processed"])

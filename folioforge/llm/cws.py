"""Operator 7: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's weighted terms are its words (lower-cased, split at what is neither
letter, digit nor beyond ASCII) with their counts. For sample k a term's hash
yields two Gamma(2, 1) variates r and c and a uniform b; with weight w,
t = floor(ln w / r + b) and the term of smallest ln c - r (t - b + 1) is drawn.
Two texts draw the same (term, t) with a probability equal to their
generalised Jaccard similarity, so the share of equal samples estimates it. The
smallest value itself stands for (term, t), so each sample is one minimum.

``with_next`` finds each row's successor in descending id order with one
shuffle of the texts: rows go to blocks of consecutive (id, text hash), cut at
sampled rows so that each holds about as many, and each block's
first row goes to the block before it as well. Sampling then works where the
block is, without another shuffle.

Defined results: a null or empty text has no terms and a fingerprint of zeros
(equal to that of any other text without words); rows that share an id are
ordered by the hash of their text; a single row follows itself; an empty table gives no rows;
only id and text are read, so further columns cannot clash; a text's terms meet in one task,
which takes memory in proportion to the text.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.store import cut, documents

SAMPLES = 32
#: Rows aimed at per block, rows sampled for each, and the most blocks, which bounds the table of their first rows.
BLOCK_ROWS, BLOCK_SAMPLE, MOST_BLOCKS = 1000, 4, 65_536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before they are lower-cased (fixed pattern).
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text (null: empty), ``block``, ``place`` in it, and the successor's text, block and place."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.coalesce("id", F.lit(-(1 << 63))).cast("long").alias("key"), F.xxhash64("text").alias("hash"))  # null ids come last
    n = rows.count()
    cuts = _cuts(rows, n)
    placed = rows.withColumn("block", _block(cuts))
    firsts = sorted(((r.block, r.x.key, r.x.hash) for r in placed.groupBy("block").agg(F.max(F.struct("key", "hash")).alias("x")).collect()), reverse=True)
    sent = [(*first, firsts[i - 1][0]) for i, first in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(sent, "block int, key long, hash long, target int")
    joined = placed.join(F.broadcast(heads), ["block", "key", "hash"], "left")
    here = F.struct(F.col("block").alias("at"), F.lit(False).alias("guest"))
    there = F.struct(F.col("target").alias("at"), F.lit(True).alias("guest"))
    dealt = joined.select("id", "text", "key", "hash", "block", F.explode(F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to")).select("id", "text", "key", "hash", "block", "to.at", "to.guest")
    dealt = dealt.repartition(len(cuts) + 1, "at")  # a block or few per task, whatever the texts' size
    order = Window.partitionBy("at").orderBy("guest", F.desc("key"), F.desc("hash"), "text", "id", "block")  # the last two keep the columns of both reads alike, so that they share one shuffle
    return (
        dealt.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"), F.lead("guest").over(order).alias("next_guest"), F.lead("block").over(order).alias("next_block"))
        .where("NOT guest")
        .select("id", "text", F.col("at").alias("block"), "place", "next_text", "next_block", F.when(F.col("next_guest"), 1).otherwise(F.col("place") + 1).alias("next_place"))
    )


def _cuts(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """Sorted (key, hash) at which blocks of about equal row counts begin."""
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    if blocks == 1:
        return []
    seen = sorted(map(tuple, rows.select("key", "hash").sample(min(1.0, BLOCK_SAMPLE * blocks / n), seed=1).collect()))
    return sorted({seen[i * len(seen) // blocks] for i in range(1, blocks)}) if seen else []


def _block(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are not beyond (key, hash), by bisection."""
    if not cuts:
        return F.lit(0)
    keys, hashes = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<long>") for i in range(2))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, p: Column) -> Column:
        key, hash = F.get(keys, at + p - 1), F.get(hashes, at + p - 1)  # null beyond the end
        return F.when((key < F.col("key")) | ((key == F.col("key")) & (hash <= F.col("hash"))), at + p).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


#: Bits of a hash for each of the two uniforms of its Gamma variate; those above serve for b.
UNIT_BITS = 25


def _unit(bits: Column, n: int) -> Column:
    """A uniform in (0, 1) from ``n`` bits."""
    return (bits + 0.5) / float(1 << n)


def _gamma(h: Column) -> Column:
    """A Gamma(2, 1) variate from the lower bits of a 64-bit hash."""
    low = F.lit((1 << UNIT_BITS) - 1)
    return -F.log(_unit(h.bitwiseAND(low), UNIT_BITS) * _unit(F.shiftrightunsigned(h, UNIT_BITS).bitwiseAND(low), UNIT_BITS))


def draw(term: Column, log_w: Column, sample: int) -> Column:
    """What the sample minimises over a text's terms; equal values mean the same term and t, as c is a hash of the
    term and t moves the value by whole steps of r. r, c and b come from bits of their own, so they are independent."""
    h1, h2 = (F.xxhash64(term, F.lit(2 * sample + i)) for i in range(2))
    left = 64 - 2 * UNIT_BITS
    high = [F.shiftrightunsigned(h, 2 * UNIT_BITS) for h in (h1, h2)]
    r, b = _gamma(h2), _unit(F.shiftleft(high[0], left).bitwiseOR(high[1]), 2 * left)
    return F.log(_gamma(h1)) - r * (F.floor(log_w / r + b) - b + 1)


def fingerprint_terms(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """From rows (keys, ``term`` as a long, ``weight``; null for a text without terms): the keys and ``print``,
    four hexadecimal digits for each sample."""
    logs = terms.select(*keys, "term", F.log("weight").alias("log_w"))
    drawn = logs.groupBy(*keys).agg(*[F.min(draw(F.col("term"), F.col("log_w"), k)).alias(f"s{k}") for k in range(samples)])
    part = lambda c: F.substring(F.hex(F.when(c.isNull(), 0).otherwise(F.xxhash64(F.floor(c * float(1 << 30)))).bitwiseAND(F.lit(0xFFFF)) + 0x10000), 2, 4)
    return drawn.select(*keys, F.lower(F.concat(*[part(F.col(f"s{k}")) for k in range(samples)])).alias("print"))


def terms_of(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Words of several text columns: keys, ``which`` (the column's place), term and weight (its count); a split's
    empty parts have no weight, but keep the key of a text without words."""
    each = rows.select(*keys, F.posexplode(F.array(*texts)).alias("which", "body"))
    words = each.select(*keys, "which", F.explode(F.split("body", PARTS)).alias("word"))
    lower = F.when(F.lower("word") == F.col("word"), F.col("word")).otherwise(F.translate("word", _UPPER, _LOWER))
    counted = words.select(*keys, "which", F.when(F.col("word") != "", F.xxhash64(lower)).alias("term"))
    return counted.groupBy(*keys, "which", "term").agg(F.count("term").alias("n")).select(*keys, "which", "term", F.when(F.col("n") > 0, F.col("n")).alias("weight"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)]
    return reduce(operator.add, same).cast("double") / samples


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, n_chars, the edited text's SHA-256, and both texts' fingerprints with their likenesses."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, id, text).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    info = rows.select("block", "place", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_block", "next_place")
    drawn = fingerprint_terms(terms_of(rows, ["block", "place"], ["text", "edited"]), ["block", "place", "which"], samples)
    of = lambda i: F.max(F.when(F.col("which") == i, F.col("print")))
    prints = drawn.groupBy("block", "place").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    known = cut(info.join(prints, ["block", "place"]))
    following = known.select(F.col("block").alias("next_block"), F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    return known.join(following, ["next_block", "next_place"]).select(
        "id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")

"""Operator 1: benchmark decontamination.

The test items' word n-grams form a broadcast hash set; each task slides a
window over the words of its documents, looks the window's hash up, compares
the words of every hit, and marks the words inside. The set is broadcast in
blocks of at most ``block_bytes`` of item text: one block in the usual case,
more (each read by one more pass over the documents, cut by a written table)
for a benchmark beyond that bound, so nothing unbounded reaches the driver.

Defined results: a null or empty text has no words, so no hits; a null item has
no window; an item without an id hits, but adds no id; an item of fewer than ``n`` words is one window; equal items all
count; equal document rows each give a row; an empty benchmark hits nothing; an empty table gives no rows;
kept columns stay inside a struct, so their names cannot clash. A text takes memory of about fifty times
its length in one task, whatever the tables' sizes.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate
from folioforge.llm.bytewords import Words, gram_hashes, words_of
from folioforge.llm.cutting import without
from folioforge.llm.store import cut, documents

NGRAM = 10
BLOCK_BYTES = 8 << 20
_SLOTS_LOG = 22

HIT = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("item", T.StringType())])


class GramSet:
    """Windows by length: a slot table for the quick no, sorted hashes, and for the sure yes the items' words, which
    stand in one buffer. A window takes 16 bytes, a word 24, a byte of text about 10."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.items = [item for item, _ in items]
        texts = [text.encode() for _, text in items]
        ends = np.cumsum([0] + [len(t) for t in texts])
        self.words = w = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), ends.astype(np.int64))
        length = np.minimum(w.counts, n)
        hashes, self.by_length = w.hashes(), {}
        for k in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == k)
            many = w.counts[rows] - k + 1
            starts = np.repeat(w.first[rows] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            known = gram_hashes(hashes, k)[starts]
            order = np.argsort(known, kind="stable")
            slots = np.zeros(1 << _SLOTS_LOG, dtype=bool)
            slots[known >> np.uint64(64 - _SLOTS_LOG)] = True
            self.by_length[k] = (slots, known[order], starts[order])

    def hits(self, w: Words) -> dict[int, list[tuple[int, int, str]]]:
        """By row: (first word, last word, item) of each window that occurs."""
        out: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        hashes = w.hashes()
        for k, (slots, known, starts) in self.by_length.items():
            g = gram_hashes(hashes, k)
            at = np.flatnonzero(slots[g >> np.uint64(64 - _SLOTS_LOG)])
            at = at[w.row[at] == w.row[at + k - 1]]
            lo, hi = np.searchsorted(known, g[at], side="left"), np.searchsorted(known, g[at], side="right")
            for i, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                gram, row = w.gram(i, k), int(w.row[i])
                first = i - int(w.first[row])
                found = {self.items[self.words.row[s]] for s in starts[a:b].tolist() if self.words.gram(s, k) == gram}
                out[row] += [(first, first + k - 1, item) for item in found]
        return out


#: The set of the current broadcast, kept while a Python worker lives.
_sets: dict[str, GramSet] = {}


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    for b in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r.item, r.text) for r in block.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", n: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document, ``row`` (the kept columns) and ``out``: n_words, n_hit, items (distinct, sorted) and
    spans (hit word runs as code point offsets, end exclusive)."""
    spark = docs.sparkSession
    cols = list(dict.fromkeys([*keep, text]))
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    held = docs.select(F.struct(*[q(c) for c in cols]).alias("doc"), q(text).alias("text"), F.array().cast(T.ArrayType(HIT)).alias("hits"))
    blocks = iter(_blocks(benchmark, item, item_text, block_bytes))
    block = next(blocks)
    while True:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        held = _pass(held, shared, n, last=following is None)
        if following is None:
            break
        block, held = following, cut(held)
    return held.select(F.struct(*[F.col("row.doc").getField(c).alias(c) for c in keep]).alias("row"), "out")


def _pass(held: DataFrame, shared, n: int, last: bool) -> DataFrame:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    done = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    more = T.StructType([T.StructField("hits", T.ArrayType(HIT))])
    key = uuid.uuid4().hex

    def make():
        if key not in _sets:
            _sets.clear()
            _sets[key] = GramSet(shared.value, n)
        known = _sets[key]

        def work(chunk):
            w = Words(chunk.data, chunk.offsets)
            found = known.hits(w)
            before = chunk.extra["hits"].to_pylist() if len(chunk.extra["hits"].flatten()) else None
            if before:
                for r, old in enumerate(before):
                    if old:
                        found[r] = [(h["first"], h["last"], h["item"]) for h in old] + found.get(r, [])
            if not last:
                return [[[{"first": a, "last": b, "item": i} for a, b, i in found.get(r, ())] for r in range(chunk.rows)]]
            return _summary(w, found, chunk.rows)

        return work

    out = annotate(held, "text", done if last else more, make, ["doc"] if last else ["doc", "text"], {"hits": "hits"})
    return out if last else out.select("row.doc", "row.text", F.col("out.hits").alias("hits"))


def _summary(w: Words, found: dict, rows: int) -> list:
    n_hit, items, starts, ends, counts = np.zeros(rows, np.int64), [[]] * rows, [], [], np.zeros(rows, np.int64)
    points = w.code_points() if found else None
    for r in sorted(found):
        mark = np.zeros(int(w.counts[r]) + 1, dtype=np.int8)
        for a, b, _ in found[r]:
            mark[a : b + 1] = 1
        edge = np.diff(mark, prepend=np.int8(0))
        first, last = np.flatnonzero(edge == 1) + w.first[r], np.flatnonzero(edge == -1) - 1 + w.first[r]
        n_hit[r], items[r], counts[r] = mark.sum(), sorted({i for *_, i in found[r] if i is not None}), len(first)
        zero = points[w.offsets[r]]
        starts.extend((points[w.start[first]] - zero).tolist())
        ends.extend((points[w.end[last]] - zero).tolist())
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
    return [w.counts, n_hit, items, lists]


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", **how) -> DataFrame:
    """The documents' own columns: without the rows that hold a test window (``documents``), or with the hit
    words cut out of ``text`` and ``n_chars`` set anew where there is such a column (``spans``)."""
    scanned = scan(docs, benchmark, keep=docs.columns, **how)
    if action == "documents":
        return scanned.where("out.n_hit = 0").select("row.*")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    new = without(F.col("row.text"), F.col("out.spans"))
    fields = {"text": new} | ({"n_chars": F.when(F.size("out.spans") > 0, F.length(new).cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return scanned.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "out.n_words",
        "out.n_hit",
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.items", ","), 256).alias("items_sha256"),
        (F.col("out.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i)
  WHERE len(w) > 0
), k AS (SELECT DISTINCT k FROM g), x AS (
  SELECT r, i, k.k, array_to_string(w[i : i + k.k - 1], ' ') AS gram
  FROM d, k, unnest(generate_series(1, len(w) - k.k + 1)) AS t(i)
  WHERE len(w) >= k.k
), h AS (SELECT x.r, x.i, x.k, g.item FROM x JOIN g ON x.k = g.k AND x.gram = g.gram),
hw AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, unnest(generate_series(0, h.k - 1)) AS t(j) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

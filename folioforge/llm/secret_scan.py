"""Operator 6: secret scans, in DataFrame functions only.

Three base kinds of span come from patterns (keyword assignments, access keys,
long hex runs). The method adds ``entropy`` spans: candidate strings slide a
window through their characters, an ``aggregate`` keeps the counts of the
window's characters and the sum of their c*log2(c) in whole micro-bits, changed
by the entering and the leaving character only, and a candidate whose largest
window entropy reaches its character class's threshold is reported unless an
allow-list pattern matches it. Spark's ``split`` on a pattern gives the text
between matches, so match offsets are running sums of lengths.

Defined results: a null or empty text has no spans; kinds may overlap; equal
rows give equal results; offsets are code points, end exclusive; an empty table gives no rows; kept
columns stay inside a struct, so their names cannot clash; time is linear in a text's length.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.cutting import let, without
from folioforge.llm.store import documents

#: The base patterns (fixed values); assign counts where its value, group 2, has 8 characters or more.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Candidates of the entropy scan: runs of key characters that have a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, tried in this order, and the window entropy (bits) that makes a candidate a secret.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[0-9A-Za-z]+$", 3.6), ("base64", r"^[0-9A-Za-z+/=_-]+$", 3.8)]
#: What looks like a key and is none: UUIDs, dates, separators, words joined by hyphens or underscores.
ALLOW = [
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9:_-]*$",
    r"^[=_/+-]+$",
    r"^[A-Za-z]+([_/-][A-Za-z]+)*[_/-]?[0-9]{0,4}$",
    r"(?i)example|placeholder|changeme|xxxxx|00000000",
]
_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_MICRO = 1_000_000
#: Counts in one long; elements added up at a time.
_PACKED, _BLOCK = 12, 256
_GAIN = [0, *(round(c * math.log2(c) * _MICRO) for c in range(1, WINDOW + 1))]
KINDS = ["assign", "access", "hex", "entropy"]
_SPANS = "array<struct<start:int,end:int,kind:int>>"


def codes(candidate: Column) -> Column:
    """Places in the alphabet, from 0, of a candidate's characters."""
    return F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(_ALPHABET)) - 1)


def entropy(codes: Column) -> Column:
    """Largest Shannon entropy, in micro-bits, of the windows over ``codes``.

    The state holds the window's counts, ``_PACKED`` of five bits in each long, and their sum of c*log2(c); each
    step changes one count up and, once the window is full, one down.
    """
    table = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    gain, units, shifts = table(_GAIN), table([1 << 5 * (p % _PACKED) for p in range(len(_ALPHABET))]), table([5 * (p % _PACKED) for p in range(len(_ALPHABET))]).cast("array<int>")
    longs = -(-len(_ALPHABET) // _PACKED)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(1 << 40).cast("long").alias("least"))

    def change(s: Column, place: Column, by: int) -> Column:
        at = F.floor(place / _PACKED).cast("int")
        now = F.call_function("shiftrightunsigned", F.get(s["counts"], at), F.get(shifts, place)).bitwiseAND(31).cast("int")
        counts = F.transform(s["counts"], lambda c, k: F.when(k == at, c + by * F.get(units, place)).otherwise(c))
        return F.struct(counts.alias("counts"), (s["sum"] + F.get(gain, now + by) - F.get(gain, now)).alias("sum"), s["least"].alias("least"))

    def step(s: Column, i: Column) -> Column:
        grown = change(s, F.get(codes, i), 1)
        after = F.when(i >= WINDOW, let(grown, lambda g: change(g, F.get(codes, i - WINDOW), -1))).otherwise(grown)
        return let(after, lambda a: F.struct(a["counts"].alias("counts"), a["sum"].alias("sum"), F.when(i >= WINDOW - 1, F.least(a["least"], a["sum"])).otherwise(a["least"]).alias("least")))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.floor((F.lit(_GAIN[WINDOW]).cast("long") - s["least"]) / WINDOW))


def _is_secret(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    least = F.lit(None).cast("long")
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(pattern), F.lit(round(bits * _MICRO)).cast("long")).otherwise(least)
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    return F.coalesce(F.when(mixed & ~allowed, let(codes(candidate), entropy) >= least), F.lit(False))


def _before(steps: Column) -> Column:
    """The sum of the elements before each, added up in blocks: what grows by one element is at most a block long."""
    none = F.array().cast("array<int>")
    blank = F.struct(F.lit(0).alias("at"), none.alias("out"))
    grow = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(steps, b * _BLOCK + 1, _BLOCK), blank, grow))

    def joined(own: Column) -> Column:
        bases = F.aggregate(own, blank, lambda s, b: grow(s, b["at"]), lambda s: s["out"])
        return F.flatten(F.zip_with(own, bases, lambda b, base: F.transform(b["out"], lambda x: x + base)))

    return F.when(F.size(steps) > 0, let(blocks, joined)).otherwise(none)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns) and ``spans``: start, end and kind (place in KINDS), sorted."""
    patterns = [ASSIGN, ACCESS, HEX, CANDIDATE]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    each = range(len(patterns))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), body.alias("body")).select("row", "body", *[F.regexp_extract_all("body", F.lit(p), F.lit(0)).alias(f"f{k}") for k, p in enumerate(patterns)])
    gaps = found.select("row", *[f"f{k}" for k in each], *[F.when(F.size(f"f{k}") > 0, F.transform(F.split("body", p, -1), F.char_length)).alias(f"b{k}") for k, p in enumerate(patterns)], *[F.transform(f"f{k}", F.char_length).alias(f"l{k}") for k in each])
    placed = gaps.select("*", *[F.when(F.size(f"f{k}") > 0, _before(F.zip_with(F.col(f"l{k}"), F.slice(f"b{k}", F.lit(1), F.size(f"f{k}")), lambda x, y: x + y))).alias(f"s{k}") for k in each])
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    good = [value, None, None, _is_secret]

    def spans(k: int) -> Column:
        def one(before: Column, i: Column) -> Column:
            start = before + F.get(F.col(f"b{k}"), i)
            return F.struct(start.alias("start"), (start + F.get(F.col(f"l{k}"), i)).alias("end"), (F.lit(True) if good[k] is None else good[k](F.get(F.col(f"f{k}"), i))).alias("good"))

        kept = F.filter(F.transform(f"s{k}", one), lambda s: s["good"])
        some = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
        return F.when(F.size(f"f{k}") > 0, some).otherwise(F.array().cast(_SPANS))

    return placed.select("row", _by_start(F.concat(*[spans(k) for k in each])).alias("spans"))


def _by_start(spans: Column) -> Column:
    """Sorted by start, then kind."""
    moved = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(moved, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents' own columns with each stretch of spans replaced by ``mark``; ``n_chars``, where there is
    such a column, follows the new text."""
    found = scan(docs, docs.columns, text)
    changed = found.select("row", (F.size("spans") > 0).alias("changed"), without(F.col("row").getField(text), F.col("spans"), mark).alias("new"))
    own = lambda c: F.col("new") if c == text else F.when(F.col("changed"), F.char_length("new").cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c)) if c == "n_chars" else F.col("row").getField(c)
    return changed.select(*[own(c).alias(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), ["doc_id"])
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("row.doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same in DuckDB, with each window's entropy counted from scratch."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    matches = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, regexp_extract_all(body, {quoted(p)}) AS f, list_transform(regexp_split_to_array(body, {quoted(p)}), lambda x: length(x)) AS b FROM d"
        for k, p in enumerate([ASSIGN, ACCESS, HEX, CANDIDATE])
    )
    classes = " ".join(f"WHEN regexp_matches(m, {quoted(p)}) THEN {round(bits * _MICRO)}" for _, p, bits in CLASSES)
    allow = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in ALLOW)
    gains = ", ".join(map(str, _GAIN))
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
raw AS ({matches}),
m AS (
  SELECT r, kind, f[i] AS m, CAST(list_sum(b[1:i]) AS BIGINT) + coalesce(CAST(list_sum(list_transform(f[1:i - 1], lambda x: length(x))) AS BIGINT), 0) AS s
  FROM raw, unnest(generate_series(1, len(f))) AS t(i)
), c AS (
  SELECT DISTINCT m, CASE {classes} END AS least FROM m
  WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allow})
), w AS (
  SELECT m, least, i, substr(m, i + j, 1) AS ch, count(*) AS n
  FROM c, unnest(generate_series(1, length(m) - {WINDOW - 1})) AS t(i), unnest(generate_series(0, {WINDOW - 1})) AS u(j)
  GROUP BY ALL
), e AS (
  SELECT m FROM (SELECT m, least, i, sum(([{gains}])[n + 1]) AS g FROM w GROUP BY m, least, i)
  GROUP BY m, least HAVING floor(({_GAIN[WINDOW]} - min(g)) / {float(WINDOW)}) >= least
), k AS (
  SELECT r, kind, s, s + length(m) AS e FROM m
  WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= {LEAST_VALUE}) OR (kind = 3 AND m IN (SELECT m FROM e))
), a AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
    string_agg(([{names}])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base,
    string_agg(([{names}])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM k GROUP BY r
)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


ORACLE = _oracle()

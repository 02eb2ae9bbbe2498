"""Operator 13: phrase collocations, by contiguous pattern growth from prefixes.

Counting starts with single words. Then every place where a frequent word is
followed by another is projected to the prefix it begins: a pointer holds the
frequent words that follow, up to the longest phrase, and equal pointers of a
task travel once with their number. All pointers of a prefix meet in one Spark
task, which grows the prefix to the right depth-first: it sorts the pointers,
takes each next word whose pointers suffice, and recurses into these alone.

A word that holds over ``1 / (4 x partitions)`` of all words is hot. A prefix
of hot words alone is no task of its own: pointers go to the prefix that ends
with their first word that is not hot (or to the whole pointer), so no task
gets more than its share. What such a task counts for the all-hot beginnings of
its prefix is a part, and the parts are added up afterwards. At most
``4 x partitions`` words are hot, so their list is broadcast; which words are
frequent is broadcast as a bit map of fixed size, which may let words through
(all counts are exact afterwards) but stops none that is frequent.

Defined results: a null text is empty, a null language "und"; repeated rows
count each time; ties go as the contract says; an empty table gives no rows;
other columns are not read. Scores are decimals of 38 digits, exact while
1000000 a a stays below 10**38.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.bytewords import LOWER, Words
from folioforge.llm.store import cut, documents

#: What ends a piece, and what parts words besides.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.ones(256, dtype=bool)
KIND[list(ENDS + GAPS)] = False
IS_END = np.zeros(256, dtype=bool)
IS_END[list(ENDS)] = True
#: Bytes of text that a task counts at a time; a longer text is counted by itself.
BUFFER = 4 << 20
#: Bits of the map of frequent words.
MAP_BITS = 25
#: Pointers in one row on their way to a prefix.
PACK = 1024
#: Parts in which each language's phrases are ranked first.
RANK_SALTS = 64


class Tokens:
    """Words of some texts: exact codes into ``dictionary``, language codes, and whether the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        _, offsets, data = texts.buffers()
        first = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[first[0] : first[-1]] if data is not None else np.zeros(0, np.uint8)
        w = Words(raw, first - first[0], KIND)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[w.row].astype(np.int64)
        self.code, self.dictionary = encoded(w, KIND)
        ends = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(IS_END[raw], out=ends[1:])
        self.follows = np.zeros(len(self.code), dtype=bool)
        if len(self.code):
            self.follows[:-1] = (w.row[1:] == w.row[:-1]) & (ends[w.start[1:]] == ends[w.start[:-1]])


def encoded(w: Words, kind: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words, equal for equal bytes, and the words' bytes by code; ``kind`` tells which bytes are in words."""
    offsets = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.cumsum(w.end - w.start, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(w.low[kind[w.low]])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """The task's texts (column 0) and languages (column 1), some ``BUFFER`` bytes at a time."""
    texts, langs, held = [], [], 0

    def done():
        return Tokens(pa.concat_arrays(texts), pa.concat_arrays(langs))

    for batch in batches:
        column = batch.column(0)
        if not len(column):
            continue
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset).astype(np.int64)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BUFFER - held, side="right")) - 1)
            if texts and held + ends[hi] - ends[lo] > BUFFER:
                yield done()
                texts, langs, held = [], [], 0
                continue
            texts.append(column.slice(lo, hi - lo))
            langs.append(batch.column(1).slice(lo, hi - lo))
            held += int(ends[hi] - ends[lo])
            lo = hi
    if texts:
        yield done()


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n over ``text`` and ``lang``; word is null in the row of a language's total."""

    def run(batches):
        for t in _buffers(batches):
            size = len(t.dictionary) + 1
            own, n = np.unique(t.lang * size + t.code, return_counts=True)
            total = np.bincount(t.lang, minlength=len(t.langs))
            lang = np.concatenate([own // size, np.arange(len(t.langs))])
            word = pa.concat_arrays([t.dictionary.take(pa.array(own % size)).cast(pa.binary()).cast(pa.string()), pa.nulls(len(t.langs), pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(t.langs, pa.string()).take(pa.array(lang)), word, pa.array(np.concatenate([n, total]).astype(np.int64))], names=["lang", "word", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _slots(lang: bytes, words: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64(lang, word) gives, cut to ``MAP_BITS`` bits."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64) & np.uint64((1 << MAP_BITS) - 1)


def frequent_map(words: DataFrame) -> np.ndarray:
    """A bit for each slot that a frequent word falls into; the driver gets at most 2 ** ``MAP_BITS`` / 64 rows."""
    slot = F.xxhash64("lang", "word").bitwiseAND((1 << MAP_BITS) - 1).alias("slot")
    bits = words.select(slot).select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    out[bits["at"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order by the columns (numbers of at least -1), the first before all others."""
    packed, now, room = [], None, 1
    for c in columns:
        size = int(c.max(initial=0)) + 2
        if now is not None and room * size < 1 << 62:
            now, room = now * size + (c + 1), room * size
        else:
            packed += [now] if now is not None else []
            now, room = c + 1, size
    packed.append(now)
    order = np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])
    return order, [c[order] for c in columns]


def pointers(rows: DataFrame, bitmap: np.ndarray, hot: dict[str, set[bytes]], longest: int) -> DataFrame:
    """lang, key (the prefix that the pointers go to), rest (each pointer's further words, a line each), n (of each)."""
    shared = rows.sparkSession.sparkContext.broadcast((np.packbits(bitmap), hot))

    def run(batches):
        packed, hot_words = shared.value
        known = np.unpackbits(packed).astype(bool)
        for t in _buffers(batches):
            if not len(t.code):
                continue
            words = t.dictionary.to_pylist()
            size = len(words)
            passes, is_hot = np.zeros((len(t.langs), size), dtype=bool), np.zeros((len(t.langs), size), dtype=bool)
            pair = np.unique(t.lang * size + t.code)
            for j, name in enumerate(t.langs):
                own = pair[pair // size == j] % size
                listed = [words[i] for i in own.tolist()]
                passes[j, own] = known[_slots(name.encode(), listed).astype(np.int64)] if len(own) else False
                is_hot[j, own] = [w in hot_words.get(name, ()) for w in listed]
            good = passes[t.lang, t.code]
            step = t.follows & good
            step[:-1] &= good[1:]
            step[-1:] = False
            at = np.flatnonzero(step)
            columns, alive = [t.lang[at] * size + t.code[at]], np.ones(len(at), dtype=bool)
            for k in range(1, longest):
                alive = alive & step[np.minimum(at + k - 1, len(step) - 1)]
                columns.append(np.where(alive, t.code[np.minimum(at + k, len(step) - 1)], -1))
            if not len(at):
                continue
            _, columns = _sorted_runs(columns)
            new = np.ones(len(at), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            begin = np.flatnonzero(new)
            number = np.diff(np.append(begin, len(at)))
            columns = [c[begin] for c in columns]
            lang, columns = columns[0] // size, [columns[0] % size, *columns[1:]]
            # the prefix ends with the first word that is not hot
            depth, open_ = np.ones(len(begin), dtype=np.int64), is_hot[lang, columns[0]]
            for k in range(1, longest):
                open_ = open_ & (columns[k] >= 0)
                depth += open_
                open_ = open_ & is_hot[lang, np.maximum(columns[k], 0)]
            yield _packed(t, words, lang, columns, depth, number)

    return rows.select("text", "lang").mapInArrow(run, "lang string, key binary, depth int, rest binary, n array<long>")


def _packed(t: Tokens, words: list[bytes], lang: np.ndarray, columns: list[np.ndarray], depth: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The sorted pointers as one row a prefix, or more where there are over ``PACK``."""
    n, longest = len(lang), len(columns)
    part = np.ones(n, dtype=bool)
    part[1:] = lang[1:] != lang[:-1]
    for k in range(longest):
        part[1:] |= (columns[k][1:] != columns[k][:-1]) & (depth[1:] > k)
    part[1:] |= depth[1:] != depth[:-1]
    first = np.flatnonzero(part)
    within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.flatnonzero(part | (within % PACK == 0))
    # the bytes of each pointer's further words, each after a space but the first, and a line end
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    cells = np.stack(columns, axis=1)
    shown = (np.arange(longest)[None, :] >= depth[:, None]) & (cells >= 0)
    row, col = np.nonzero(shown)
    size = sizes[cells[row, col]]
    ends_line = np.ones(n, dtype=np.int64)
    width = np.bincount(row, size, minlength=n).astype(np.int64) + np.maximum(shown.sum(axis=1) - 1, 0) + ends_line
    at = np.cumsum(width) - width
    out = np.full(int(width.sum()), 0x20, dtype=np.uint8)
    out[at + width - 1] = 0x0A
    before = np.cumsum(size + 1) - (size + 1)
    start_of_row = np.zeros(n, dtype=np.int64)
    lead = np.ones(len(row), dtype=bool)
    lead[1:] = row[1:] != row[:-1]
    start_of_row[row[lead]] = before[lead]
    put = at[row] + before - start_of_row[row]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(put, size) + inner] = flat[np.repeat(base[cells[row, col]], size) + inner]
    edges = np.append(at, len(out))
    rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(edges[first], len(out))), pa.py_buffer(out)]).cast(pa.binary())
    keys, deep = t.dictionary.take(pa.array(cells[first, 0])).cast(pa.binary()), depth[first] > 1
    if deep.any():
        keys = pc.replace_with_mask(keys, pa.array(deep), pa.array([b" ".join(words[c] for c in cells[i, : depth[i]].tolist()) for i in first[deep].tolist()], pa.binary()))
    counts = pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), pa.array(number.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(t.langs, pa.string()).take(pa.array(lang[first])), keys, pa.array(depth[first].astype(np.int32)), rest, counts], names=["lang", "key", "depth", "rest", "n"])


class Projection:
    """The pointers of some prefixes, sorted by prefix, then by their further words."""

    def __init__(self, of: np.ndarray, rest: bytes, number: np.ndarray, longest: int):
        data = np.frombuffer(rest, dtype=np.uint8)
        line = np.concatenate([[0], np.cumsum(data == 0x0A)])
        w = Words(data, np.array([0, len(data)], dtype=np.int64), _LINE_KIND)
        code, self.dictionary = encoded(w, _LINE_KIND)
        row = line[w.start]
        lead = np.ones(len(row), dtype=bool)
        lead[1:] = row[1:] != row[:-1]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(lead, np.arange(len(row)), 0))
        cells = np.full((longest, len(of)), -1, dtype=np.int64)
        cells[place, row] = code
        order, columns = _sorted_runs([of, *cells])
        self.of, self.words, self.number = columns[0], columns[1:], number[order]
        self.least, self.found = 0, []

    def grow(self, prefix: tuple[int, ...], lo: int, hi: int) -> None:
        """Adds what prolongs the prefix of the pointers ``lo`` to ``hi``, each longer one before its next sibling."""
        if len(prefix) == len(self.words):
            return
        column = self.words[len(prefix)][lo:hi]
        begin = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        total = np.add.reduceat(self.number[lo:hi], begin)
        end = np.append(begin[1:], hi - lo)
        for i in np.flatnonzero((total >= self.least) & (column[begin] >= 0)).tolist():
            longer = (*prefix, int(column[begin[i]]))
            self.found.append((longer, int(total[i])))
            self.grow(longer, lo + int(begin[i]), lo + int(end[i]))


_LINE_KIND = np.ones(256, dtype=bool)
_LINE_KIND[[0x20, 0x0A]] = False


def grown(packs: DataFrame, hot: dict[str, set[bytes]], least: int, longest: int, partitions: int) -> DataFrame:
    """lang, phrase, n: of prefixes that end with a word that is not hot all phrases of ``least`` or more; parts of all-hot ones."""
    shared = packs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot_words = shared.value
        held: list[pa.RecordBatch] = []

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, key = (batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])
            group = np.cumsum(new) - 1
            starts = pa.array(np.flatnonzero(new))
            langs, keys, depths = (batch.column(i).take(starts).to_pylist() for i in (0, 1, 2))
            counts = batch.column(4)
            sizes = np.diff(counts.offsets.to_numpy())
            number = counts.flatten().to_numpy()
            rest = batch.column(3)
            ends = np.frombuffer(rest.buffers()[1], dtype=np.int32, count=len(rest) + 1, offset=4 * rest.offset)
            p = Projection(np.repeat(group, sizes), rest.buffers()[2][int(ends[0]) : int(ends[-1])], number, longest - 1)
            p.least = least
            edges = np.searchsorted(p.of, np.arange(int(group[-1]) + 2))
            out_lang, out_phrase, out_n = [], [], []
            words = p.dictionary.to_pylist()
            for g, (lang, key, depth) in enumerate(zip(langs, keys, depths, strict=True)):
                lo, hi = int(edges[g]), int(edges[g + 1])
                total = int(p.number[lo:hi].sum())
                parts = key.split(b" ")
                all_hot = [w in hot_words.get(lang, ()) for w in parts]
                p.found = []
                if total >= least or all_hot[0]:
                    for k in range(2, depth + 1):
                        part = all(all_hot[:k])
                        if part or total >= least:
                            out_lang.append(lang)
                            out_phrase.append(b" ".join(parts[:k]))
                            out_n.append(total)
                if total >= least and depth < longest:
                    p.grow((), lo, hi)
                for more, n in p.found:
                    if depth + len(more) <= longest:
                        out_lang.append(lang)
                        out_phrase.append(b" ".join([key, *(words[c] for c in more)]))
                        out_n.append(n)
            return pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_phrase, pa.binary()).cast(pa.string()), pa.array(out_n, pa.int64())], names=["lang", "phrase", "n"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # all but the last prefix, which may go on in the next batch
            lang, key = batch.column(0), batch.column(1)
            i = n - 1
            while i > 0 and key[i - 1] == key[n - 1] and lang[i - 1] == lang[n - 1]:
                i -= 1
            if held and i == 0 and held[-1].column(1)[-1] == key[0] and held[-1].column(0)[-1] == lang[0]:
                held.append(batch)
                continue
            if i:
                held.append(batch.slice(0, i))
            if held:
                yield work(joined())
            held[:] = [batch.slice(i)]
        if held:
            yield work(joined())

    # the prefix itself is hashed, so that a language that most rows share is dealt out too
    dealt = packs.repartition(partitions, "lang", "key").sortWithinPartitions("lang", "key")
    return dealt.mapInArrow(run, "lang string, phrase string, n long")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, partitions: int | None = None) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    ``inside``: the percentage of a phrase's occurrences from which a longer candidate around it replaces it.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    counted = cut(word_counts(rows).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word IS NULL").select("lang", "n")
    words = counted.where("word IS NOT NULL")
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in words.where(F.col("n") > every / (4 * partitions)).collect():  # fewer than 4 x partitions words
        hot.setdefault(r.lang, set()).add(r.word.encode())
    packs = pointers(rows, frequent_map(words), hot, longest)
    phrases = cut(grown(packs, hot, least, longest, partitions).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least))
    return best(phrases, words, totals, inside, top)


def best(phrases: DataFrame, words: DataFrame, totals: DataFrame, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ranking of candidates: phrases (lang, phrase, a), frequent words (lang, word, n), totals (lang, n)."""
    parts = F.split("phrase", " ")
    counts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    joined = lambda xs, a, b: F.array_join(F.slice(xs, a, b), " ")
    k = F.col("k")
    cuts = phrases.select("lang", "phrase", "a", parts.alias("ws")).select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined("ws", F.lit(1), k).alias("left"), joined("ws", k + 1, F.size("ws") - k).alias("right"))
    of = lambda name, out: counts.select("lang", F.col("part").alias(name), F.col("f").alias(out))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    longer = phrases.select("lang", "a", parts.alias("ws")).where(F.size("ws") > 2)
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.array_join(F.slice("ws", i, size), " "))))
    around = longer.select("lang", "a", F.explode(places).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < inside * F.col("a").cast("decimal(20,0)"))).drop("around")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
parts AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
f AS (SELECT lang, len, phrase, count(*) AS f FROM (SELECT lang, len, unnest(list_transform(range(1, len(ws) - len + 2), lambda i: array_to_string(ws[i : i + len - 1], ' '))) AS phrase FROM parts, (SELECT unnest([1, 2, 3]) AS len) WHERE len(ws) >= len) GROUP BY lang, len, phrase),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len > 1 AND f >= 10),
cut AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1 : c.len], ' ')),
lowest AS (SELECT lang, phrase, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase, a FROM c WHERE len = 3),
kept AS (SELECT * FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = lowest.lang AND i.phrase = lowest.phrase AND 100 * i.a >= 50 * lowest.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""

"""Operator 12: the language of each word, by Viterbi, and so of each text.

Words are runs of ASCII letters and digits and of other bytes above 0x7F, A-Z
lower-cased. The scripts of a word's letters narrow its candidates to the
languages that were seen with that script while learning; a script that no
language was seen with says nothing. For each candidate a word scores the
logarithm of its probability, byte by byte given up to three bytes before,
word ends included; counts of longer contexts are smoothed by those of shorter
ones. A path over the words pays ``switch`` to change language. The cheapest
path labels every word, runs of one label are spans, and the text's language
is the one whose spans hold the most letters (ties: the higher score, then the
smaller name). The score is those letters' share of all, each span counted
with the probability of its language given its words alone.

Viterbi runs over blocks of ``BLOCK`` words at once: first what each block does
to each possible state before it, then the blocks of a text in order, then all
words. That is exact, and its cost follows the number of words however they are
spread over texts.

The model is learned from at most ``SAMPLE`` documents, those with the smallest
hash of their id; all their words count. It keeps the ``GRAMS`` most frequent
byte sequences. Defined results: a text that is null or has no letter is
``und`` with score 0; so is every text if nothing was learned; a text whose
letters give no evidence gets the most frequent language learned; of texts that
share an id the one with the smallest hash is learned from; equal texts get
equal results; an empty table gives no rows; kept columns stay inside a struct,
so their names cannot clash. A text takes memory of about sixty times its
length in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate, list_array
from folioforge.llm.bytewords import Words
from folioforge.llm.store import cut, documents

SAMPLE, GRAMS = 6000, 1 << 18
ORDER = 4
BLOCK = 64
SWITCH = 9.0
#: A script's share of a language's letters from which the language is a candidate for its words.
SCRIPT_SHARE = 0.001
#: What smoothing adds to a context's count, in units of the next shorter context's probabilities.
SMOOTH = 4.0
#: Entries of blocks times languages squared that are held at a time.
HELD = 1 << 21

#: Scripts by the first and last code points of their main letter ranges in Unicode.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x591, 0x5F4)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF)],
}
NAMES = list(SCRIPTS)
_EDGES = sorted((lo, hi, i) for i, n in enumerate(NAMES) for lo, hi in SCRIPTS[n])
_LO, _HI, _OF = (np.array(x) for x in zip(*_EDGES, strict=True))
_LETTER = regex.compile(r"\p{L}")


def letters_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the number of its letters in known scripts, and a bit mask of these scripts."""
    low = w.low.astype(np.int64)
    n = len(low)
    point = np.zeros(n, dtype=np.int64)
    after = lambda k: np.concatenate([low[k:], np.zeros(min(k, n), np.int64)])[:n] & 0x3F
    one, two, three, four = low < 0x80, (low >= 0xC0) & (low < 0xE0), (low >= 0xE0) & (low < 0xF0), low >= 0xF0
    point = np.where(one, low, point)
    if not one.all():
        point = np.where(two, (low & 0x1F) << 6 | after(1), point)
        point = np.where(three, (low & 0x0F) << 12 | after(1) << 6 | after(2), point)
        point = np.where(four, (low & 0x07) << 18 | after(1) << 12 | after(2) << 6 | after(3), point)
    at = np.maximum(np.searchsorted(_LO, point, side="right") - 1, 0)
    inside = (point >= _LO[at]) & (point <= _HI[at])
    bit = np.where(inside, np.left_shift(1, _OF[at]), 0)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.stack([w.start, w.end], axis=1).ravel()
    both = [np.add.reduceat(np.append(inside.astype(np.int64), 0), edges)[::2], np.bitwise_or.reduceat(np.append(bit, 0), edges)[::2]]
    return both[0], both[1]


def keys_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): for each byte of each word and the end after it, the last up to ``ORDER`` bytes packed into
    one number. Words are framed by spaces, so no byte of a key is zero but those in front."""
    size = w.end - w.start
    n = len(size)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    framed = np.full(int(at[-1]) + 1, 0x20, dtype=np.uint32)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    framed[np.repeat(at[:-1] + 1, size) + inner] = w.low[np.repeat(w.start, size) + inner]
    word = np.repeat(np.arange(n), size + 1)
    place = np.arange(int(at[-1])) - np.repeat(at[:-1], size + 1)  # bytes of context before: 1 + place
    here = np.arange(int(at[-1])) + 1
    key = framed[here].copy()
    for back in range(1, ORDER):
        on = place >= back - 1
        key[on] |= framed[here[on] - back] << np.uint32(8 * back)
    return word, key


def shorter(key: np.ndarray) -> np.ndarray:
    """The key without its first byte."""
    size = (key > 0xFF).astype(np.int64) + (key > 0xFFFF) + (key > 0xFFFFFF)
    return key & ((np.uint64(1) << (size.astype(np.uint64) * np.uint64(8))) - np.uint64(1)).astype(np.uint32)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # logarithms
    scripts: np.ndarray  # for each script a mask over languages; all of them where it was never seen
    slots: np.ndarray  # keys by hashed slot
    values: np.ndarray  # logarithms of probabilities by slot and language
    floor: float
    switch: float = SWITCH
    bits: int = field(default=0)

    def emissions(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's scores by language (zero where it has no letter of a known script), its letters and its scripts."""
        letters, scripts = letters_of(w)
        word, key = keys_of(w)
        n, total = len(w.start), np.zeros((len(w.start), len(self.langs)))
        left, at = key, np.arange(len(key))
        value = np.full((len(key), len(self.langs)), self.floor, dtype=np.float32)
        for _ in range(ORDER):
            slot = _slot(left, self.bits)
            hit = self.slots[slot] == left
            value[at[hit]] = self.values[slot[hit]]
            left, at = shorter(left[~hit]), at[~hit]
            on = left > 0
            left, at = left[on], at[on]
        for j in range(len(self.langs)):
            total[:, j] = np.bincount(word, value[:, j], minlength=n)
        allowed = np.zeros((n, len(self.langs)), dtype=bool)
        for s in range(len(NAMES)):
            own = (scripts >> s & 1).astype(bool)
            if own.any():
                allowed |= own[:, None] & self.scripts[s][None, :]
        known = allowed.any(axis=1)
        total = np.where(known[:, None], np.where(allowed, total - total.max(axis=1, keepdims=True), -1e4), 0.0)
        return total, letters, scripts

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's language, its scores, its letters."""
        scores, letters, _ = self.emissions(w)
        return viterbi(scores, w.counts, self.prior, self.switch), scores, letters


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _step(state: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Best scores before a word's own, and the language that each comes from; a tie stays in its language."""
    top = state.argmax(axis=-1)
    best = np.take_along_axis(state, top[..., None], axis=-1) - switch
    stay = state >= best
    return np.where(stay, state, best), np.where(stay, np.arange(state.shape[-1]), top[..., None])


def viterbi(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; ``counts`` words belong to each text in turn."""
    n, k = scores.shape
    if n == 0 or k == 1:
        return np.zeros(n, dtype=np.int64)
    per = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), per)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(counts) - counts, per) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(counts, per) - number * BLOCK)
    effect = np.empty((len(text), k, k))
    for lo in range(0, len(text), max(1, HELD // (k * k))):
        own = slice(lo, lo + max(1, HELD // (k * k)))
        state = np.full((len(begin[own]), k, k), -np.inf)
        state[:, np.arange(k), np.arange(k)] = 0.0
        for t in range(int(size[own].max())):
            live = np.flatnonzero(size[own] > t)
            e = scores[begin[own][live] + t]
            state[live] = _step(state[live], switch)[0] + e[:, None, :]
        effect[own] = state
    # the state that each block begins with, block by block of all texts together
    entry = np.empty((len(text), k))
    entry[number == 0] = prior
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(int(number.max()) + 2))
    for t in range(1, int(number.max()) + 1):
        at = order[edges[t] : edges[t + 1]]
        came = (entry[at - 1][:, :, None] + effect[at - 1]).max(axis=1)
        entry[at] = came - came.max(axis=1, keepdims=True)
    back = np.empty((n, k), dtype=np.int16)
    state = entry
    for t in range(int(size.max())):
        live = np.flatnonzero(size > t)
        new, back[begin[live] + t] = _step(state[live], switch)
        state[live] = new + scores[begin[live] + t]
    # where a block's path begins, for each language it may end with; then the ends, from the last block back
    origin = np.tile(np.arange(k), (len(text), 1))
    for t in range(int(size.max())):
        live = np.flatnonzero(size > t)
        origin[live] = np.take_along_axis(origin[live], back[begin[live] + t].astype(np.int64), axis=1)
    ends = state.argmax(axis=1)
    for t in range(int(number.max()), 0, -1):
        at = order[edges[t] : edges[t + 1]]
        ends[at - 1] = origin[at, ends[at]]
    path = np.empty(n, dtype=np.int64)
    now = ends
    for t in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(size > t)
        path[begin[live] + t] = now[live]
        now[live] = back[begin[live] + t, now[live]]
    return path


def _counts(train: DataFrame, langs: list[str]) -> DataFrame:
    """key, lang, n: how often the byte sequences of each length occur; scripts' letters as keys below zero."""

    def run(batches):
        for batch in batches:
            keys, of = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                w = Words(data, np.array([0, len(data)], dtype=np.int64))
                letters, scripts = letters_of(w)
                word, key = keys_of(w)
                key = key[letters[word] > 0]
                for s in range(len(NAMES)):
                    own = int(letters[(scripts >> s & 1).astype(bool)].sum())
                    keys.append(np.full(own, -1 - s, dtype=np.int64))
                    of.append(np.full(own, lang, dtype=np.int64))
                while len(key):
                    keys.append(key.astype(np.int64))
                    of.append(np.full(len(key), lang, dtype=np.int64))
                    key = shorter(key)
                    key = key[key > 0]
            if keys:
                pair, n = np.unique(np.concatenate(keys) * len(langs) + np.concatenate(of), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair // len(langs)), pa.array((pair % len(langs)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "lang", "n"])

    return train.select("text", "lang").mapInArrow(run, "key long, lang int, n long").groupBy("key", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", sample: int = SAMPLE, grams: int = GRAMS) -> Model | None:
    """Learn from the rows that have an id, a text and a language; None if there are none. "und" is no language."""
    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "und") & F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    ids = F.broadcast(known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample))  # at most ``sample`` ids
    train = cut(known.join(ids, "id").groupBy("id").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "text", "lang")).alias("x")).select("x.*"))
    found = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return None
    rows = _counts(train.select("text", (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int").alias("lang")), langs)
    wide = rows.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("lang") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(len(langs))])
    table = wide.orderBy(F.col("key") >= 0, F.desc("n"), "key").limit(grams + len(NAMES)).toPandas().sort_values("key")
    count = table[[f"n{j}" for j in range(len(langs))]].to_numpy(dtype=np.float64)
    key = table["key"].to_numpy()
    share = np.zeros((len(NAMES), len(langs)))
    share[-1 - key[key < 0]] = count[key < 0]
    mask = share / np.maximum(share.sum(axis=0), 1) >= SCRIPT_SHARE
    mask[~mask.any(axis=1)] = False
    values, floor = _probabilities(key[key >= 0].astype(np.uint32), count[key >= 0])
    total = np.array([found[x] for x in langs], dtype=np.float64)
    bits = max(8, int(np.ceil(np.log2(max(1, (key >= 0).sum())))) + 3)
    model = Model(langs, np.log(total / total.sum()), mask, np.zeros(1 << bits, np.uint32), np.zeros((1 << bits, len(langs)), np.float32), floor, bits=bits)
    rank = np.argsort(count[key >= 0].sum(axis=1), kind="stable")  # of keys that share a slot the most frequent stays
    slot = _slot(key[key >= 0].astype(np.uint32), bits)
    model.slots[slot[rank]] = key[key >= 0][rank].astype(np.uint32)
    model.values[slot[rank]] = values[rank]
    return model


def _probabilities(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Logarithms of each key's last byte given those before, by language; ``key`` ascends."""
    p = np.zeros_like(count)
    for size in range(1, ORDER + 1):
        own = np.flatnonzero((key >= (1 << 8 * (size - 1))) & (key < (1 << 8 * size)))
        if not len(own):
            continue
        context, back = np.unique(key[own] >> np.uint32(8), return_inverse=True)
        total = np.zeros((len(context), count.shape[1]))
        np.add.at(total, back, count[own])
        if size == 1:
            p[own] = (count[own] + 0.5) / (total[back] + 128)
            continue
        at = np.minimum(np.searchsorted(key, shorter(key[own])), len(key) - 1)
        under = np.where((key[at] == shorter(key[own]))[:, None], p[at], 1e-6)
        p[own] = (count[own] + SMOOTH * np.maximum(under, 1e-6)) / (total[back] + SMOOTH)
    return np.log(np.maximum(p, 1e-9)).astype(np.float32), float(np.log(1e-7))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))])


def spans_of(w: Words, path: np.ndarray, scores: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of words of one label inside one text: row, first and last word, label, letters, probability."""
    if not len(path):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])]))
    last = np.append(first[1:], len(path)) - 1
    total = np.add.reduceat(scores, first, axis=0)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total[np.arange(len(first)), path[first]]) / np.exp(total).sum(axis=1)
    return w.row[first], first, last, path[first], np.add.reduceat(letters, first), p


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns) beside ``out``: lang_pred, score, and the spans (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def work(chunk):
            lettered = np.array([known is not None and _LETTER.search(t) is not None for t in chunk.texts()], dtype=bool)
            if known is None:
                return [pa.array(["und"] * chunk.rows), np.zeros(chunk.rows), [[]] * chunk.rows]
            w, k = Words(chunk.data, chunk.offsets), len(known.langs)
            path, scores, letters = known.label(w)
            row, first, last, lang, held, p = spans_of(w, path, scores, letters, k)
            per = np.zeros((chunk.rows, k))
            sure = np.zeros((chunk.rows, k))
            np.add.at(per, (row, lang), held)
            np.add.at(sure, (row, lang), held * p)
            # letters first, then what they are worth; a text without evidence is in the most frequent language
            best = np.lexsort((np.broadcast_to(-np.arange(k), per.shape), np.broadcast_to(known.prior, per.shape) * (per.sum(axis=1, keepdims=True) == 0), sure, per), axis=1)[:, -1]
            mine = sure[np.arange(chunk.rows), best]
            score = np.where(per.sum(axis=1) > 0, mine / np.maximum(per.sum(axis=1), 1), np.exp(known.prior[best]))
            names = np.array(known.langs, dtype=object)
            pred = np.where(lettered, names[best], "und")
            points = w.code_points()
            zero = points[w.offsets[row]]
            flat = pa.StructArray.from_arrays([pa.array((points[w.start[first]] - zero).astype(np.int32)), pa.array((points[w.end[last]] - zero).astype(np.int32)), pa.array(names[lang], pa.string()), pa.array(p)], names=["start", "end", "lang", "p"])
            offsets = list_array(np.zeros(len(row)), np.bincount(row, minlength=chunk.rows), pa.float64()).offsets
            return [pa.array(pred, pa.string()), np.where(lettered, np.clip(score, 0.0, 1.0), 0.0), pa.ListArray.from_arrays(offsets, flat)]

        return work

    return annotate(docs, text, OUT, make, keep)


def held_out(id: str | Column = "doc_id") -> Column:
    """Rows kept from learning: CRC-32 of the id's text leaves 2 when divided by 4 (a null id is not held out)."""
    column = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    found = identify(docs, model, ["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "out.lang_pred", "out.score", F.size("out.spans").alias("n_spans"))

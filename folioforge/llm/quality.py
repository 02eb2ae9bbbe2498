"""Operator 8: quality by ordinal cumulative-link regression.

P(grade <= j) = sigmoid(theta_j - w.x) with ascending thresholds theta and one
weight vector w over hashed text features: relative frequencies of the raw
bytes' 4-grams (case, symbols and layout show there) and the words that occur
(content shows there), each in buckets of its own. The fit maximises the penalised
likelihood of the graded ratings of at most ``SAMPLE`` labelled documents,
those with the smallest hash of their id; scoring reads every document whole.

Defined results: a null or empty text has no features, so the thresholds alone
grade it; with ratings of one grade only, that grade is expected everywhere; ties are kept;
of texts that share an id the one with the smallest hash is learned from; equal
rows get equal results; an empty table gives no rows; kept columns stay inside a
struct, so their names cannot clash. A text takes memory of about sixty times
its length in one task, whatever the table's size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate
from folioforge.llm.bytewords import Words
from folioforge.llm.store import cut, documents

SAMPLE = 2500
BITS = 16
ROUNDS = 120
#: One rated document in so many is kept from the fit and sets the threshold, at which ``KEEP`` of those of the best
#: grade stay; with fewer of these than ``LEAST_CALIBRATED`` the threshold is 0.5.
FOLDS, KEEP, LEAST_CALIBRATED = 5, 0.985, 30


def features(w: Words, raw: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of a chunk; buckets below 2**bits are 4-grams, those above are words."""
    rows = len(w.counts)
    size = np.diff(w.offsets)
    if len(raw) >= 4:
        b = raw.astype(np.uint32)
        gram = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
        row = np.repeat(np.arange(rows), np.maximum(size - 3, 0))
        start = w.offsets[:-1]
        at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size - 3, 0)) - np.maximum(size - 3, 0), np.maximum(size - 3, 0)) + np.repeat(start, np.maximum(size - 3, 0))
        grams, value = gram[at].astype(np.int64), (10.0 / np.sqrt(np.maximum(size - 3, 1)))[row]
    else:
        row, grams, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    value = value / np.sqrt(np.maximum(size - 3, 1))[row]
    key = w.row.astype(np.uint64) << np.uint64(bits) | w.hashes() >> np.uint64(64 - bits)
    key = np.unique(key)
    return (
        np.concatenate([row, (key >> np.uint64(bits)).astype(np.int64)]),
        np.concatenate([grams, (key & np.uint64((1 << bits) - 1)).astype(np.int64) + (1 << bits)]),
        np.concatenate([value, np.full(len(key), 0.3)]),
    )


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[float]
    least: float = 0.5  # probability of more than the lowest grade from which a document is kept

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", id: str = "doc_id", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """Fit on the rated documents among ``docs``; a document rated more than once counts with its lowest grade."""
    rated = ratings.where(F.col(grade).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.min(grade).cast("double").alias("grade"))
    chosen = rated.orderBy(F.xxhash64(id), id).limit(sample)
    found = docs.select(F.col(id), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), id)
    held = cut(found.groupBy(id).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("grade").alias("grade")))
    kind = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])

    def make():
        def work(chunk):
            buckets, values = [], []
            w = Words(chunk.data, chunk.offsets)
            row, bucket, value = features(w, chunk.data)
            key, back = np.unique(row << (BITS + 1) | bucket, return_inverse=True)
            value = np.bincount(back, value)
            ends = np.searchsorted(key >> (BITS + 1), np.arange(chunk.rows + 1))
            for a, b in zip(ends, ends[1:], strict=False):
                buckets.append((key[a:b] & ((1 << (BITS + 1)) - 1)).astype(np.int32))
                values.append(value[a:b].astype(np.float32))
            return [buckets, values]

        return work

    rows = annotate(held, "text", kind, make, [id, "grade"]).select(F.col("row").getField(id).alias("id"), "row.grade", "out.*").toPandas().sort_values("id")
    grades = sorted(set(rows["grade"])) or [0.0]
    if len(grades) == 1:
        return Model(np.zeros(2 << BITS), np.zeros(0), grades)
    fold = rows["id"].map(lambda i: zlib.crc32(f"fold {i}".encode()) % FOLDS == 0).to_numpy(dtype=bool)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), rows["bucket"].map(len).to_numpy())
    bucket, value, y = np.concatenate(rows["bucket"].to_list()).astype(np.int64), np.concatenate(rows["value"].to_list()).astype(np.float64), rows["grade"].map(grades.index).to_numpy()
    del rows
    if len(np.unique(y[~fold])) < len(grades):  # too few to spare any
        fold[:] = False
    on = ~fold[row]
    place = np.cumsum(~fold) - 1
    weights, thresholds = _train(place[row[on]].astype(np.int32), bucket[on], value[on], y[~fold], len(grades))
    model = Model(weights, thresholds, grades)
    best = fold & (y == len(grades) - 1)
    if best.sum() >= LEAST_CALIBRATED:
        kept = model.tails(np.bincount(row, value * weights[bucket], minlength=len(y)))[best, 0]
        model.least = float(np.clip(np.quantile(kept, 1 - KEEP), 0.01, 0.99))
    return model


def _train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, k: int, l2: float = 2e-4, rate: float = 0.05):
    """Adam on the cumulative-link likelihood; thresholds are a first one and the logs of the steps between them."""
    n = len(y)
    w = np.zeros(2 << BITS)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, ROUNDS + 1):
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        score = np.bincount(row, value * w[bucket], minlength=n)
        hi, lo = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        of_score = dlo - dhi
        of_edge = np.bincount(y + 1, dhi, minlength=k + 1) - np.bincount(y, dlo, minlength=k + 1)
        of_theta = of_edge[1:k]
        of_t = np.array([of_theta.sum(), *(of_theta[j:].sum() * np.exp(t[j]) for j in range(1, k - 1))])
        grad = np.concatenate([np.bincount(bucket, value * of_score[row], minlength=len(w)) / n - l2 * w, of_t / n])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[: len(w)], t + move[len(w) :]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns) beside ``out``: expected_grade and tails, P(grade >= g) by ascending g."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def make():
        known = shared.value
        steps = np.diff(known.grades)

        def work(chunk):
            w = Words(chunk.data, chunk.offsets)
            row, bucket, value = features(w, chunk.data)
            tails = known.tails(np.bincount(row, value * known.weights[bucket], minlength=chunk.rows))
            return [known.grades[0] + tails @ steps, list(tails)]

        return work

    return annotate(docs, text, out, make, keep)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the label table: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))


def selected(least: float = 0.5, grade: int = 1) -> Column:
    """Whether the probability of at least the ``grade``-th grade above the lowest reaches ``least`` (such as ``Model.least``)."""
    return F.coalesce(F.get("out.tails", grade - 1) >= least, F.lit(True))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, grades(documents(spark, sf_dir, "labels")))
    tail = lambda k: F.get("out.tails", k).alias(f"p_ge_{k + 1}")
    return score(docs, model, ["doc_id"]).select("row.doc_id", "out.expected_grade", tail(0), tail(1), selected(model.least).alias("keep"))

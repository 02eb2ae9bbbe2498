"""Operator 3: toxicity by a linear-chain conditional random field.

Two states, clean and toxic, over the words of a text. A word's features are
the word, its prefixes of 4 to 6 bytes, so inflected forms share weights, and
the word together with the one before it. Documents carry one label, so words
are labelled from it: in a toxic document those with a feature that (over the
sample's documents) goes with toxic ones are toxic, all others clean. Words
without a weighted feature all have the same potential, so forward-backward
runs over the weighted words alone, with the run of plain words between two of
them as one power of the transition matrix: exact, and linear in the weighted
words. The marginals' sum of -log(1 - p) over a document goes through a
logistic fit to the document score.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the
smallest hash of their id; all their words count, and every feature whose
document counts deviate from chance by ``LEAST_Z``. Texts are fitted in runs of
``RUN`` words, each given the label before it, and equal runs once with their
number. Defined results: a null or empty text has no evidence and gets the
score of none; without labels of both kinds the score is the smoothed share of
toxic labels (0.25 without any, so nothing is rejected); of texts that share an id the one with the smallest hash is
learned from; equal rows get equal scores; an empty table gives no rows; kept
columns stay inside a struct, so their names cannot clash. A text takes memory
of about fifty times its length in one task, whatever the table's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate, list_array
from folioforge.llm.bytewords import Words, gram_hashes
from folioforge.llm.store import cut, documents

SAMPLE = 6000
PREFIXES = (4, 5, 6)
#: Documents that a feature must occur in, and how many deviations its toxic ones must be from chance.
LEAST_DOCS, LEAST_Z = 4, 4.0
#: The share of toxic ones among its documents that makes it a toxic feature.
TOXIC_SHARE = 0.9
RUN = 64
#: Runs that one step of the fit holds at a time.
BATCH = 8192


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    move: np.ndarray  # 2 x 2 transition scores
    slope: float
    shift: float

    def evidence(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document the sum of -log(1 - p); the weighted words' indices and marginals."""
        weight = np.zeros(len(w.start))
        if len(self.features):
            for ids in feature_ids(w, self.features):
                weight += np.where(ids >= 0, self.weights[ids], 0.0)
        at = np.flatnonzero(weight)
        p = self._marginals(w, at, weight[at])
        return np.bincount(w.row[at], -np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(w.counts)), at, p

    def _marginals(self, w: Words, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0)
        rows, first, count = np.unique(w.row[at], return_index=True, return_counts=True)
        place = at - w.first[w.row[at]]
        gap = np.diff(place, prepend=0) - 1
        gap[first] = place[first]
        move = np.exp(self.move)
        plain = move * np.exp([0.0, self.bias])
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        top, rest = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
        run = lambda n: top + ((values[1] / values[0]) ** n)[:, None, None] * rest
        emit = np.exp(np.stack([np.zeros(len(at)), np.clip(self.bias + weight, -40, 40)], axis=1))
        after = np.append(w.counts[rows], 0)[:-1] - place[first + count - 1] - 1
        forward, backward = np.empty((len(at), 2)), np.empty((len(at), 2))
        state = np.tile([1.0, 0.0], (len(rows), 1))
        by_length = np.argsort(-count, kind="stable")
        first, count, after, state = first[by_length], count[by_length], after[by_length], state
        for k in range(int(count[0])):
            live = int(np.searchsorted(-count, -k, side="left"))
            i = first[:live] + k
            s = np.einsum("ni,nij->nj", state[:live], run(gap[i].astype(float)))
            s = (s @ move) * emit[i]
            state[:live] = forward[i] = s / s.sum(axis=1, keepdims=True)
        state = run(after.astype(float)).sum(axis=2)
        for k in range(int(count[0]) - 1, -1, -1):
            live = int(np.searchsorted(-count, -k, side="left"))
            i = first[:live] + k
            backward[i] = state[:live]
            s = (emit[i] * state[:live]) @ move.T
            s = np.einsum("nij,nj->ni", run(gap[i].astype(float)), s)
            state[:live] = s / s.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log(evidence + 1e-4) + self.shift)))


def word_features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each kind: every word's hash, and where it applies (a prefix must be shorter than the word, a pair
    inside one text)."""
    length, own = w.end - w.start, w.hashes()
    pair, inside = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=bool)
    pair[1:], inside[1:] = gram_hashes(own, 2), w.row[1:] == w.row[:-1]
    return [(own, np.ones(len(own), dtype=bool)), *[(w.hashes(n), length > n) for n in PREFIXES], (pair, inside)]


KINDS = 2 + len(PREFIXES)


def feature_ids(w: Words, features: np.ndarray) -> list[np.ndarray]:
    """For each kind every word's position in ``features``, or -1."""
    out = []
    for h, on in word_features(w):
        at = np.minimum(np.searchsorted(features, h), len(features) - 1)
        out.append(np.where((features[at] == h) & on, at, -1))
    return out


def _share_sample(train: DataFrame) -> DataFrame:
    """hash, toxic and clean documents with it, over the sample."""

    def run(batches):
        for batch in batches:
            tables = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                own = np.unique(np.concatenate([h[on] for h, on in word_features(Words(data, np.array([0, len(data)])))]))
                tables.append(np.stack([own.view(np.int64), np.full(len(own), toxic), np.full(len(own), 1 - toxic)]))
            if tables:
                h, toxic, clean = np.concatenate(tables, axis=1)
                keys, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(back, toxic).astype(np.int64)), pa.array(np.bincount(back, clean).astype(np.int64))], names=["h", "toxic", "clean"])

    return train.select("text", F.col("toxic").cast("long")).mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents among ``docs``; the sample's size is the only bound."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg((F.max(label) > 0).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(id), id).limit(sample)
    held = docs.select(F.col(id), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), id)
    train = cut(held.groupBy(id).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    n_toxic, n = train.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic = n_toxic or 0
    share = (n_toxic + 0.5) / (n + 2)
    nothing = np.zeros(0)
    if not 0 < n_toxic < n:
        return Model(nothing.astype(np.uint64), nothing, 0.0, np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    expected = (F.col("toxic") + F.col("clean")) * (n_toxic / n)
    found = _share_sample(train).where((F.col("toxic") + F.col("clean") >= LEAST_DOCS) & (F.abs(F.col("toxic") - expected) >= LEAST_Z * F.sqrt(expected))).toPandas().sort_values("h", key=lambda s: s.to_numpy().view(np.uint64))
    features = found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    telling = ((found["toxic"] / (found["toxic"] + found["clean"])).to_numpy() >= TOXIC_SHARE) if len(found) else nothing.astype(bool)
    model = Model(features, np.zeros(len(features)), 0.0, np.zeros((2, 2)), 0.0, 0.0)
    if len(features):
        model.weights, model.bias, model.move = _train(_runs(train, features, telling), len(features))
    seen = score_column(train, model, ["toxic"], "text").select("row.toxic", "out.evidence").toPandas()
    model.slope, model.shift = _logistic(np.log(seen["evidence"].to_numpy() + 1e-4), seen["toxic"].to_numpy(dtype=float))
    return model


@dataclass
class Runs:
    """Runs of words: length, the label before, labels, number of equal runs; and the weighted words' features as
    flat places (run, word) and ids."""

    length: np.ndarray
    before: np.ndarray
    y: np.ndarray
    number: np.ndarray
    place: np.ndarray
    id: np.ndarray


def _runs(train: DataFrame, features: np.ndarray, telling: np.ndarray) -> Runs:
    """The texts' runs of ``RUN`` words; runs that are equal in all the model sees are counted, not repeated."""

    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                ids = np.stack(feature_ids(Words(data, np.array([0, len(data)])), features), axis=1)
                y = ((ids >= 0) & telling[ids]).any(axis=1) & bool(toxic)
                for lo in range(0, len(ids), RUN):
                    part = ids[lo : lo + RUN]
                    word, kind = np.nonzero(part >= 0)
                    seen = np.stack([word, part[word, kind]]).astype(np.int32)
                    out.append((len(part), bool(lo and y[lo - 1]), np.flatnonzero(y[lo : lo + RUN]).astype(np.uint8).tobytes(), seen.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["length", "before", "y", "seen"])

    rows = train.select("text", "toxic").mapInArrow(run, "length int, before boolean, y binary, seen binary").groupBy("length", "before", "y", "seen").agg(F.count("*").alias("number"))
    rows = rows.toPandas().sort_values(["length", "before", "number", "y", "seen"])
    y = np.zeros((len(rows), RUN), dtype=bool)
    for i, raw in enumerate(rows["y"]):
        y[i, np.frombuffer(raw, dtype=np.uint8)] = True
    seen = [np.frombuffer(raw, dtype=np.int32).reshape(2, -1) for raw in rows["seen"]]
    run_of = np.repeat(np.arange(len(rows)), [x.shape[1] for x in seen])
    both = np.concatenate(seen, axis=1) if seen else np.zeros((2, 0), np.int32)
    return Runs(rows["length"].to_numpy(), rows["before"].to_numpy(dtype=bool), y, rows["number"].to_numpy(dtype=float), run_of * RUN + both[0], both[1])


def _train(runs: Runs, n: int, rounds: int = 45, rate: float = 0.3, l2: float = 1e-6):
    """Adam on the penalised log-likelihood; expectations by forward-backward, ``BATCH`` runs at once.

    The likelihood is a mean over all words, of which one feature holds few, so the penalty has to be small.
    """
    theta = np.zeros(n + 5)  # weights, bias, the 2 x 2 moves
    theta[n], theta[n + 1 :] = -2.0, [0.5, -1.0, -0.5, 0.0]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = float((runs.length * runs.number).sum())
    starts = np.searchsorted(runs.place, np.arange(0, len(runs.length) + BATCH, BATCH) * RUN)
    for step in range(1, rounds + 1):
        grad = np.zeros_like(theta)
        for b, lo in enumerate(range(0, len(runs.length), BATCH)):
            own = slice(starts[b], starts[b + 1])
            _gradient(theta, n, grad, runs, slice(lo, lo + BATCH), runs.place[own] - lo * RUN, runs.id[own])
        grad = grad / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:n].copy(), float(theta[n]), theta[n + 1 :].reshape(2, 2).copy()


def _gradient(theta: np.ndarray, n: int, grad: np.ndarray, runs: Runs, part: slice, place: np.ndarray, id: np.ndarray) -> None:
    """Adds the part's share of the log-likelihood's gradient: observed minus expected counts."""
    y, number, before = runs.y[part], runs.number[part], runs.before[part]
    count, steps = len(y), int(runs.length[part].max())
    y = y[:, :steps]
    mask = np.arange(steps) < runs.length[part][:, None]
    weight = np.bincount(place, theta[id], minlength=count * RUN).reshape(count, RUN)[:, :steps]
    emit = np.ones((count, steps, 2))
    emit[..., 1] = np.exp(np.clip(weight + theta[n], -30, 30))
    move = np.exp(theta[n + 1 :].reshape(2, 2))
    start = np.stack([~before, before], axis=1).astype(float)
    fwd, bwd, scale = np.empty((count, steps, 2)), np.ones((count, steps, 2)), np.ones((count, steps))
    state = start
    for t in range(steps):
        s = (state @ move) * emit[:, t]
        scale[:, t] = s.sum(axis=1)
        fwd[:, t] = state = s / scale[:, t, None]
    for t in range(steps - 2, -1, -1):
        on = mask[:, t + 1, None]
        bwd[:, t] = np.where(on, ((emit[:, t + 1] * bwd[:, t + 1]) @ move.T) / scale[:, t + 1, None], 1.0)
    p = (fwd * bwd)[..., 1] / (fwd * bwd).sum(axis=2)
    error = np.where(mask, y - p, 0.0) * number[:, None]
    grad[:n] += np.bincount(id, np.pad(error, ((0, 0), (0, RUN - steps))).ravel()[place], minlength=n)
    grad[n] += error.sum()
    after = emit * bwd / scale[..., None] * (mask * number[:, None])[..., None]
    prior = np.concatenate([start[:, None], fwd[:, :-1]], axis=1)
    last = np.concatenate([before[:, None], y[:, :-1]], axis=1)
    for a in (0, 1):
        for c in (0, 1):
            seen = ((last == a) & (y == c) & mask).sum(axis=1) @ number
            grad[n + 1 + 2 * a + c] += seen - move[a, c] * np.einsum("ns,ns->", prior[..., a], after[..., c])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Slope and shift by damped Newton steps with a little smoothing."""
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        beta += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("spans", T.ArrayType(_SPAN))])


def score_column(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``row`` (the kept columns) beside ``out``: score, evidence, and the offending words' code point spans
    with their marginals (those of at least ``threshold``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def work(chunk):
            w = Words(chunk.data, chunk.offsets)
            evidence, at, p = known.evidence(w)
            bad, p = at[p >= threshold], p[p >= threshold]
            points = w.code_points() if len(bad) else np.zeros(1, np.int64)
            zero = points[w.offsets[w.row[bad]]] if len(bad) else 0
            flat = pa.StructArray.from_arrays([pa.array((points[w.start[bad]] - zero).astype(np.int32)), pa.array((points[w.end[bad]] - zero).astype(np.int32)), pa.array(p.astype(np.float64))], names=["start", "end", "p"]) if len(bad) else pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            counts = np.bincount(w.row[bad], minlength=chunk.rows)
            offsets = list_array(np.zeros(len(bad)), counts, pa.float64()).offsets
            return [known.score(evidence), evidence, pa.ListArray.from_arrays(offsets, flat)]

        return work

    return annotate(docs, text, OUT, make, keep)


def held_out(id: str | Column = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id's text divides by 5 (a null id is not held out)."""
    column = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The documents whose score is below ``threshold``, with their own columns."""
    model = fit(docs, labels.where(~held_out()), **how)
    return score_column(docs, model, docs.columns).where(F.col("out.score") < threshold).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = score_column(docs, model, ["doc_id"])
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "out.score", (F.col("out.score") >= 0.5).cast("int").alias("predicted"))

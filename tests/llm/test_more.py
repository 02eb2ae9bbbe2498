"""Brute force for fuzzy notices, held-out quality, and rows of odd kinds that the other tests leave out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm.bytewords import Words
from folioforge.llm import bpe, cws, decontaminate, licenses, quality, secret_scan, simhash, toxicity
from folioforge.llm.store import clear, shared_dir


def fewest_edits(notice, text):
    """Fewest edits of the notice at any place of the text, by the table of all prefixes."""
    row = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(notice, 1):
        new = np.empty_like(row)
        new[0] = i
        step = np.minimum(row[:-1] + (np.frombuffer(text.encode("utf-32-le"), np.uint32) != ord(c)), row[1:] + 1)
        new[1:] = np.minimum.accumulate(np.concatenate([[i], step]) - np.arange(len(text) + 1))[1:] + np.arange(1, len(text) + 1)
        row = new
    return int(row.min())


def test_notices_equal_brute_force(spark):
    r = random.Random(7)
    texts, letters = [], "abcdefghij klmnopqrst"
    for label, notice, errors in licenses.NOTICES:
        for edits in range(errors + 3):
            x = list(notice)
            for _ in range(edits):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], [r.choice(letters)], [x[k], r.choice(letters)]])
            texts.append("so " + " ".join("".join(x).split()) + " and more")
    texts += ["released under the " + x + " license" for x in ("bsd", "isc", "gpl", "mpl", "mit", "mi", "apache")] + ["", "a b c"]
    got = {x.row.i: x.out for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"]).collect()}
    hits = 0
    for i, text in enumerate(texts):
        for label, notice, errors in licenses.NOTICES:
            name, found = licenses.NAMES.get(notice), any(s.label == label for s in got[i].spans)
            fewest = fewest_edits(notice, text)
            others = [n for l, n, _ in licenses.NOTICES if l == label and n != notice]
            if fewest > errors and all(fewest_edits(n, text) > 6 for n in others):
                assert not found, (text, label)
            elif fewest <= errors and (name is None or (name if len(name) >= licenses.LEAST_NAME else f" {name} ") in text):
                assert found, (text, label)
                hits += 1
    assert hits > 40 and all("mit" not in got[len(texts) - 9 + k].labels for k in range(4))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, ratings.where(~out))
    rows = quality.score(docs, model, ["doc_id"]).select("row.doc_id", "out.expected_grade", quality.selected(model.least).alias("keep")).join(ratings.where(out), "doc_id").where("grade IS NOT NULL").collect()
    kept = {g: np.mean([r.keep for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert len(rows) > 500 and kept[2] >= 0.97 and kept[1] >= 0.85 and kept[0] <= 0.25
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)]
    assert means == sorted(means)


def test_quality_scores_equal_plain_loops(spark):
    """Tail probabilities from counted 4-grams and words, one text at a time, for a model of random weights."""
    r = np.random.default_rng(6)
    model = quality.Model(r.normal(size=2 << quality.BITS), np.array([-0.5, 0.8]), [0.0, 1.0, 5.0])
    texts = ["", "abc", "abcd", "The the THE cat, sat. été!", "x " * 500, "日本語テキスト and more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for x in quality.score(df, model, ["doc_id"]).collect():
        raw = texts[x.row.doc_id].encode()
        grams = [int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> (32 - quality.BITS) for i in range(len(raw) - 3)]
        w = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        words = {int(h) >> (64 - quality.BITS) for h in w.hashes()}
        total = sum(model.weights[g] * 10 / len(grams) for g in grams) + sum(0.3 * model.weights[(1 << quality.BITS) + b] for b in words)
        tails = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert list(x.out.tails) == pytest.approx(tails) and x.out.expected_grade == pytest.approx(tails[0] + 4 * tails[1])


def test_quality_fit_climbs_its_likelihood():
    """The fitted parameters beat their neighbours in the penalised likelihood of the ratings."""
    r = np.random.default_rng(2)
    n, m = 300, 6
    row, bucket, value = np.repeat(np.arange(n), m), np.tile(np.arange(m), n), r.normal(size=n * m)
    true = r.normal(size=m) * 2
    y = np.searchsorted([-1.0, 1.0], (value.reshape(n, m) @ true) + r.logistic(size=n))
    w, t = quality._train(row, bucket, value, y, 3)

    def likelihood(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = value.reshape(n, m) @ w[:m]
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        return np.log(np.maximum(sig(edges[y + 1] - s) - sig(edges[y] - s), 1e-12)).mean() - 1e-4 * (w[:m] ** 2).sum()

    best = likelihood(w, t)
    for j in range(m):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[j] += step
            assert likelihood(moved, t) < best
    assert likelihood(w, t + 0.3) < best and likelihood(w, t - 0.3) < best


LONG = "word longer " * 80_000


@pytest.fixture(scope="module")
def long(spark):
    rows = [(1, LONG), (1, "another text of id one"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("row", "out", "spans", "fp", "n_chars", "hits", "body", "key")])


def test_long_texts_repeated_ids_and_clashing_names(spark, long):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, toxic int, grade int")
    items = spark.createDataFrame([(1, "longer word longer word longer word longer word longer word")], "item_id long, text string")
    hit = {(x.row.doc_id, x.out.n_words): x.out for x in decontaminate.scan(long, items, keep=long.columns).collect()}
    assert hit[1, 160_000].n_hit == 159_998  # the first word and the last one are in no window
    tox = toxicity.score_column(long, toxicity.fit(long, labels), long.columns).collect()
    good = quality.score(long, quality.fit(long, labels), long.columns).collect()
    found = licenses.scan(long, long.columns).collect()
    grouped = simhash.group(long, ["doc_id"]).collect()
    coded = bpe.encode(long, None, long.columns).collect()
    drawn = cws.fingerprints(long).collect()
    secrets = secret_scan.scan(long, long.columns).collect()
    assert {len(x) for x in (tox, good, found, grouped, coded, drawn, secrets)} == {5}
    assert max(x.out.n_tokens for x in coded) == max(x.out.n_words for x in found) == 160_000
    assert sorted(x.n_chars for x in drawn) == [0, 0, 0, 22, len(LONG)]


def test_empty_tables(spark, long):
    none = long.where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int, grade int")
    assert toxicity.score_column(none, toxicity.fit(none, labels), ["doc_id"]).count() == 0
    assert quality.score(none, quality.fit(none, labels), ["doc_id"]).count() == 0
    assert bpe.encode(none, None, ["doc_id"]).count() == licenses.scan(none, ["doc_id"]).count() == secret_scan.redact(none).count() == 0
    assert bpe.encode(none, None, ["doc_id"]).schema == bpe.encode(long, None, ["doc_id"]).schema


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other words here"), (None, "no id token=abcdefgh12"), (4, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.where("false")):
        seen = table
        for name, stage in p.STAGES:
            made = stage(spark, seen, str(tmp_path))
            if name != p.STAGES[-1][0]:
                assert made.dtypes == docs.dtypes, name
            seen = made
        n = seen.count()
        assert n == (5 if table is docs else 0)
    assert shared_dir(spark)
    clear(spark)

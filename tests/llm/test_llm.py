"""Each operator against brute force, and on nulls, empty texts, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import same
from pyspark.sql import functions as F

from folioforge.llm import bpe, cws, decontaminate, extract, licenses, quality, secret_scan, simhash, toxicity, warc
from folioforge.llm.queries import ORACLES, QUERIES

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same text here, twice over."), (4, "Same text here, twice over."), (5, "été " * 3000), (6, "x" * 5000), (None, "no id"), (7, "one")]
EXTRA = ["row", "out", "text_", "n_words", "spans", "fp", "_id", "count"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "same TEXT here twice"), (5, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", ["op5_extract", "op8_quality", "op9_warc", "op10_licenses"])
def test_queries_return_every_row(spark, sf, name):
    table = "pages" if name in ("op5_extract", "op9_warc") else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert QUERIES[name](spark, sf).count() == n * (2 if name == "op9_warc" else 1)


def test_decontaminate(spark, odd, bench):
    hit = {r.row.doc_id: r.out for r in decontaminate.scan(odd, bench, keep=["doc_id"]).collect()}
    assert hit[1].n_words == hit[2].n_words == 0 and hit[4]["items"] == ["4"] and hit[4].n_hit == 4 and hit[7]["items"] == ["1"]
    left = decontaminate.decontaminate(odd, bench)
    assert left.dtypes == odd.dtypes and left.count() == 6
    cut = decontaminate.decontaminate(odd, bench, "spans")
    assert cut.dtypes == odd.dtypes and cut.count() == len(ODD) and cut.where("doc_id = 7").first().text == ""
    text = "pre " + " ".join(f"w{i}" for i in range(2, 14)) + " post"
    long = decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench, keep=["doc_id"], block_bytes=20).first().out
    assert long.n_hit == 12 and long.spans[0].start == 4 and text[long.spans[0].end :] == " post"
    none = bench.where("false")
    assert decontaminate.decontaminate(odd, none).count() == len(ODD) and decontaminate.scan(odd.where("false"), bench, keep=["doc_id"]).count() == 0


def test_decontaminate_uses_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (7, "d e f"), (None, "d e f"), (None, None)], "item_id long, text string")
    for size in (1 << 20, 4):
        got = {r.row.doc_id: (r.out.n_hit, r.out["items"]) for r in decontaminate.scan(docs, items, keep=["doc_id"], block_bytes=size).collect()}
        assert got == {1: (3, []), 2: (3, ["7"]), 3: (0, [])}
    many = spark.createDataFrame([(1, "a b c")] * 500 + [(2, "d e f")], "item_id long, text string")
    assert sum(len(b) for b in decontaminate._blocks(many, "item_id", "text", 1 << 20)) == 2


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own, r = Tokenizer.from_file(path), bpe.Codec(path), random.Random(5)
    parts = ["a", "the", "in", "é", "é", "Σ", "İ", "日本", "½", "!?", "'s", "'LL", " ", "\n", "\x1c", "\x85", " ", " ", "　", "​", "<|endoftext|>", "😀", "_", "</w>", "12"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(500)]
    texts += ["".join(r.choice(a) for _ in range(r.randint(1500, 6000))) for a in ("ab", "the", "aeinrst", "z", "abcdefghijklmnopqrstuvwxyz")]
    for t in texts:
        wanted = library.encode(t, add_special_tokens=False)
        got = own.encode(t)
        assert got == wanted.ids
        decoded = library.decode(wanted.ids, skip_special_tokens=False)
        sink = bpe.Digests(own.v)
        for pieces in own.stream(t):
            sink.add(pieces)
        assert sink.finish() == (len(wanted.ids), hashlib.sha256(" ".join(map(str, wanted.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        machine = bpe.Decoder(own.v, symbols=True)
        assert "".join(machine.push_all(wanted.ids[i : i + 3]) for i in range(0, len(wanted.ids), 3)) == decoded
    rows = bpe.encode(odd, path, ["doc_id"]).select("row.doc_id", "out.*")
    got = {r.doc_id: r for r in bpe.decode(rows, path).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[1].text == ""
    assert got[5].text.replace(" ", "") == "été" * 3000 and got[6].text == "x" * 5000 + " " and got[5].n_tokens == len(got[5].ids)


def test_bpe_query_equals_the_library(spark, sf, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = QUERIES["op2_bpe"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_bpe_slices_give_what_whole_texts_give(monkeypatch):
    from tokenizers import Tokenizer

    library, own, r = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Codec(bpe.default_vocabulary()), random.Random(9)
    monkeypatch.setattr(bpe, "SLICE", 40)
    parts = ["the ", "é", "e\u0301", " \u0301", "日本語", "<|endoftext|>", "!?", "'s ", "\n", "\x1c", "ab" * 45, "word", "12 ", "\u3000", "x" * 90 + "-"]
    for _ in range(200):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert not own.encoder.held
    long = "abc" * 60_000
    assert own.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_bpe_window_is_bounded():
    v = bpe.Vocabulary(bpe.default_vocabulary())
    e = bpe.Encoder(v)
    for _ in range(200):
        list(e.push(b"abc" * 50))
        assert len(e.held) <= e.window


def test_toxicity(spark, odd):
    r = random.Random(2)
    rows = [(i, " ".join(["w%d" % r.randrange(300) for _ in range(r.randint(5, 60))] + (["nastyword", "nastyish"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where("doc_id < 300"))
    got = {r.row.doc_id: r.out for r in toxicity.score_column(docs, model, ["doc_id"]).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, _, t in rows)
    s = got[300].spans[0]
    assert rows[300][1][s.start : s.end] == "nastyword"
    for i, text, toxic in rows:
        assert [text[s.start : s.end] for s in got[i].spans] == ["nastyword", "nastyish"] * toxic
    kept = toxicity.reject(odd, labels)
    assert kept.dtypes == odd.dtypes and kept.count() == len(ODD)
    assert 0 <= toxicity.score_column(odd, toxicity.fit(odd, labels.where("false")), ["doc_id"]).first().out.score <= 1


def test_crf_marginals_equal_the_plain_recursion():
    r = np.random.default_rng(1)
    from folioforge.llm.bytewords import Words

    data = np.frombuffer(b"a bad c d bad bad e f g" + b"h bad" + b"i", dtype=np.uint8)
    w = Words(data, np.array([0, 23, 28, 29]))
    features = np.unique(w.hashes()[1:2])
    model = toxicity.Model(features, np.array([2.3]), -1.5, r.normal(size=(2, 2)), 1.0, 0.0)
    _, at, p = model.evidence(w)
    move = np.exp(model.move)
    for row in range(3):
        idx = range(w.first[row], w.first[row + 1])
        emit = [np.array([1, np.exp(-1.5 + 2.3 * (w.word(i) == b"bad"))]) for i in idx]
        f, b = [], [np.ones(2)]
        s = np.array([1.0, 0.0])
        for e in emit:
            s = (s @ move) * e
            f.append(s)
        for e in emit[:0:-1]:
            b.append(move @ (e * b[-1]))
        full = [(x * y)[1] / (x * y).sum() for x, y in zip(f, b[::-1], strict=True)]
        for i, q in zip(at, p, strict=True):
            if i in idx:
                assert q == pytest.approx(full[i - idx[0]])


def test_crf_gradient_equals_differences():
    r = np.random.default_rng(4)
    length, before = np.array([1, 5, 9, 9]), np.array([False, True, False, True])
    y = np.zeros((4, toxicity.RUN), dtype=bool)
    y[:, :9] = r.random((4, 9)) < 0.3
    y &= np.arange(toxicity.RUN) < length[:, None]
    place, id = np.array([1 * 64 + 2, 1 * 64 + 2, 2 * 64, 3 * 64 + 8]), np.array([0, 1, 1, 2])
    runs, theta = toxicity.Runs(length, before, y, np.array([1.0, 3.0, 1.0, 2.0]), place, id), r.normal(size=8)

    def likelihood(t):
        move, total = t[4:].reshape(2, 2), 0.0
        for i in range(4):
            w = np.bincount(place[place // 64 == i] % 64, t[id[place // 64 == i]], minlength=64) + t[3]
            z, own, a = np.array([0.0 if not before[i] else -np.inf, 0.0 if before[i] else -np.inf]), 0.0, int(before[i])
            for k in range(length[i]):
                z = np.logaddexp.reduce(z[:, None] + move, axis=0) + np.array([0.0, w[k]])
                c = int(y[i, k])
                own, a = own + move[a, c] + c * w[k], c
            total += runs.number[i] * (own - np.logaddexp.reduce(z))
        return total

    grad = np.zeros(8)
    toxicity._gradient(theta, 3, grad, runs, slice(0, 4), place, id)
    for k in range(8):
        e = np.eye(8)[k] * 1e-5
        assert grad[k] == pytest.approx((likelihood(theta + e) - likelihood(theta - e)) / 2e-5, abs=1e-6)


def test_toxicity_held_out_and_repeated_ids(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.01
    docs = spark.createDataFrame([(1, f"t{i % 7} word") for i in range(60)] + [(2, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(k), labels) for k in (1, 5)]
    assert (models[0].slope, models[0].shift) == (models[1].slope, models[1].shift)
    assert toxicity.score_column(docs.where("false"), models[0], ["doc_id"]).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def smallest(ids, fps, radius=2):
    low = list(ids)
    for _ in ids:
        new = [min(low[j] for j in range(len(ids)) if bin(fps[i] ^ fps[j]).count("1") <= radius) for i in range(len(ids))]
        if new == low:
            return low
        low = new
    return low


def test_simhash_equals_brute_force(spark, docs, sf):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    wanted = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, smallest([r.doc_id for r in rows], fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()} == wanted


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash_links_any_bucket_size(spark, bucket):
    r = random.Random(9)
    fps = set()
    for base in [r.getrandbits(64) for _ in range(12)]:
        for _ in range(12):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    ids = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), bucket=bucket)
    root = {x.node: x.root for x in simhash.components(edges).collect()}
    assert [root.get(i, i) for i in ids] == smallest(ids, fps)


def test_simhash_odd_rows(spark, odd):
    got = simhash.group(odd, ["doc_id"]).collect()
    assert len(got) == len(ODD)
    by = {r.row.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    kept = simhash.deduplicate(odd)
    assert kept.dtypes == odd.dtypes and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7]
    assert simhash.deduplicate(odd.where("false")).count() == 0


def test_deduplicate_decides_by_row(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue black white")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, "kept too: another text of id seven"), (None, "no id but here twice"), (None, "no id but here twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.deduplicate(df).collect())
    assert got == sorted({(str(i), t) for i, t in rows if (i, t) != (5, a)})


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash_links_any_radius(spark, radius, bucket):
    r = random.Random(5)
    fps = {x ^ (1 << k) for x in [r.getrandbits(64) for _ in range(4)] for k in [*range(12), 40, 50]} | {r.getrandbits(64)}
    fps |= {x ^ 3 << 20 for x in list(fps)[:9]} | {x ^ 1 << 63 for x in list(fps)[:9]}
    ids = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), radius=radius, bucket=bucket)
    root = {x.node: x.root for x in simhash.components(edges).collect()}
    assert [root.get(i, i) for i in ids] == smallest(ids, [i % (1 << 64) for i in ids], radius)


def test_extract(spark):
    rows = [(1, None), (2, ""), (3, "plain &amp; simple"), (4, "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>T &lt;1&gt;</h1><p>Some  text\nhere.<p>More <b>bold<script>x</script> text.</article><footer>&copy; me</footer>"), (5, "<article><p>" + "long text. " * 20000 + "</p></article>")]
    got = {r.row.page_id: r.out for r in extract.extract(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "plain & simple"
    assert got[4].text == "T <1>\nSome text here.\nMore bold text." and got[5].n_chars == 11 * 20000 - 1
    model = extract.train()
    right = wrong = missed = 0
    for seed in range(5000, 5060):  # beyond the pages of the training
        source, main = extract.template(seed)
        page = extract.Page(source)
        yes = extract.decode(page, *extract.score(model, [page]))
        got = {w.rstrip(",.") for node, t in page.runs if yes[node] for w in t.split()}
        right, wrong, missed = right + len(got & main), wrong + len(got - main), missed + len(main - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def entropy(s, window=secret_scan.WINDOW):
    return max(int((secret_scan._GAIN[window] - sum(secret_scan._GAIN[c] for c in Counter(s[i : i + window]).values())) // window) for i in range(len(s) - window + 1))


MAIN = "<article><p>The whole text</p></article>"


@pytest.mark.parametrize("page", ["<html><head><title>t</title><body>%s", "<html><head><title>t</title><meta a=b>%s", "<head><title>t</title>%s", "<noscript>%s", "<svg>%s", "<template>%s", "<svg>%s<svg><text>no</text></svg>"])
def test_unclosed_elements_hide_no_text(page):
    source = page % MAIN
    assert [t for _, t in extract.Page(source).runs] == ["The whole text"] and warc.plain_text(source) == "The whole text"
    closed = "<head><script>'<body>'</script><noscript>no</noscript></head><svg><svg></svg>no</svg><template>no</template>" + MAIN
    assert [t for _, t in extract.Page(closed).runs] == ["The whole text"] and warc.plain_text(closed) == "The whole text"
    assert [t for _, t in extract.Page("<select>" + MAIN).runs] == ["The whole text"]


def test_secrets(spark, odd):
    r = random.Random(3)
    texts = ['api_key = "abcd1234EFGH" x', "token: short token=secret=abcdefghij", "AKIA" + "A1" * 6 + " AKIAABC", "é 0123456789abcdef0123456789abcdef", "".join(r.choice(secret_scan._ALPHABET[:62]) for _ in range(40)), "550e8400-e29b-41d4-a716-446655440000"]
    got = [r.spans for r in secret_scan.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1), ["i"]).orderBy("row.i").collect()]
    flat = [[(s.start, s.end, secret_scan.KINDS[s.kind]) for s in x] for x in got]
    assert flat[0] == [(0, 23, "assign")] and flat[2] == [(0, 16, "access")] and (2, 34, "hex") in flat[3] and flat[4] == [(0, 40, "entropy")] and flat[5] == []
    values = ["".join(r.choice("ab12XY+/z") for _ in range(r.randint(20, 50))) for _ in range(30)]
    assert all(x.e == entropy(x.v) for x in spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.entropy(secret_scan.codes(F.col("v"))).alias("e")).collect())
    out = secret_scan.redact(odd)
    assert out.dtypes == odd.dtypes and out.exceptAll(odd).count() == 0
    assert secret_scan.redact(spark.createDataFrame([(texts[0],)], "text string")).first().text == '[SECRET]" x'


def test_weighted_sampling(spark, odd):
    rows = sorted(ODD, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    got = cws.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(text) // 2
        edited = hashlib.sha256((text[: len(text) - h] + following[:h]).encode()).hexdigest()
        assert any(r.id == key and r.n_chars == len(text) and r.edited_sha256 == edited for r in got)
    prints = {r.id: r.fingerprint for r in got}
    assert prints[1] == prints[2] == prints[3] == "0" * 4 * cws.SAMPLES and prints[4] != prints[5]
    assert cws.fingerprints(odd.where("false")).count() == 0
    assert cws.fingerprints(odd.where("doc_id = 7")).first().near_next == 1.0


def test_blocks_hold_like_numbers_of_rows(spark, monkeypatch):
    monkeypatch.setattr(cws, "BLOCK_ROWS", 50)
    rows = [(7, f"t{i}") for i in range(600)] + [(i, f"u{i}") for i in range(100, 690)] + [(1 << 60, "far"), (-(1 << 60), "low")] + [(None, f"n{i}") for i in range(8)]
    got = cws.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1200 and max(Counter(r.block for r in got).values()) < 300
    at = {(r.block, r.place): r for r in got}
    assert len(at) == 1200 and all(at[r.next_block, r.next_place].text == r.next_text for r in got)
    ids, r = [], got[0]
    for _ in got:
        ids.append(r.id)
        r = at[r.next_block, r.next_place]
    start = ids.index(1 << 60)
    assert ids[start:] + ids[:start] == sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))


def test_secrets_in_long_texts(spark):
    r = random.Random(6)
    blob = "".join(r.choice(secret_scan._ALPHABET[:62]) for _ in range(200_000))
    many = " ".join(f"é{i} token=abcdefgh{i:05d}" for i in range(20_000))
    df = spark.createDataFrame([(1, blob), (2, many), (3, None)], "doc_id long, text string").coalesce(1)
    began = time.time()
    got = {x.row.doc_id: x.spans for x in secret_scan.scan(df, ["doc_id"]).collect()}
    cut = {x.doc_id: x.text for x in secret_scan.redact(df).collect()}
    assert time.time() - began < 90
    assert [(s.start, s.end, s.kind) for s in got[1]] == [(0, 200_000, 3)] and cut[1] == "[SECRET]" and cut[3] is None and got[3] == []
    base = [(m.start(), m.end()) for m in re.finditer(secret_scan.ASSIGN.replace("(?i:", "(?:"), many)]
    assert len(base) == 20_000 and [(s.start, s.end) for s in got[2] if s.kind == 0] == base
    assert cut[2] == " ".join(f"é{i} [SECRET]" for i in range(20_000))


def sampled(text, samples):
    """The sampler in plain Python: XXH64 chains like Spark's xxhash64, logarithms and minima."""
    h64 = xxhash.xxh64_intdigest
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    unit = lambda x, n: (x + 0.5) / 2**n
    gamma = lambda h: -math.log(unit(h % 2**25, 25) * unit((h >> 25) % 2**25, 25))
    counts, out = Counter(words(text)), []
    for k in range(samples):
        least = None
        for word, n in counts.items():
            seed = h64(struct.pack("<q", signed(h64(word.encode(), 42))), 42)
            h1, h2 = h64(struct.pack("<i", 2 * k), seed), h64(struct.pack("<i", 2 * k + 1), seed)
            r, b = gamma(h2), unit((h1 >> 50) << 14 | h2 >> 50, 28)
            value = math.log(gamma(h1)) - r * (math.floor(math.log(n) / r + b) - b + 1)
            least = value if least is None else min(least, value)
        out.append("0000" if least is None else f"{h64(struct.pack('<q', math.floor(least * 2**30)), 42) & 0xFFFF:04x}")
    return out


def test_weighted_sampling_equals_the_plain_sampler(spark, sf, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    same = total = 0
    for r in QUERIES["op7_fingerprints"](spark, sf).collect():
        own, following = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        h = len(own) // 2
        edited = own[: len(own) - h] + following[:h]
        assert hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256
        if len(own) > 3000:
            continue
        for got, plain in ((r.fingerprint, sampled(own, cws.SAMPLES)), (r.edited_fingerprint, sampled(edited, cws.SAMPLES))):
            parts = [got[i : i + 4] for i in range(0, len(got), 4)]
            same, total = same + sum(a == b for a, b in zip(parts, plain, strict=True)), total + len(parts)
        assert r.near_edited == sum(r.fingerprint[i : i + 4] == r.edited_fingerprint[i : i + 4] for i in range(0, len(r.fingerprint), 4)) / cws.SAMPLES
    assert total > 5000 and same / total > 0.9999


@pytest.mark.parametrize("a, b", [([1], [2]), ([1], [3]), ([2], [3]), ([5], [6]), ([40, 20, 13, 10, 8, 7, 6, 5, 4, 4], [4, 5, 6, 7, 8, 10, 13, 20, 40, 40])])
def test_samples_collide_at_the_generalised_jaccard_rate(spark, a, b):
    """Mean likeness over 600 pairs of texts of 30 terms, against the true value and a sampler with random numbers of its own."""
    pairs, size = 600, 30
    weights = [[w[i % len(w)] for i in range(size)] for w in (a, b)]
    true = sum(map(min, *weights)) / sum(map(max, *weights))
    rows = [(p, side, random.Random(p * size + i).getrandbits(63), float(weights[side][i])) for p in range(pairs) for side in (0, 1) for i in range(size)]
    prints = cws.fingerprint_terms(spark.createDataFrame(rows, "p long, side int, term long, weight double"), ["p", "side"]).toPandas().pivot(index="p", columns="side", values="print")
    same = [x[0][i : i + 4] == x[1][i : i + 4] for x in prints.to_numpy() for i in range(0, 4 * cws.SAMPLES, 4)]
    own = np.random.default_rng(1)
    r, c, u = own.gamma(2, size=(20_000, size)), own.gamma(2, size=(20_000, size)), own.random((20_000, size))
    drawn = []
    for w in weights:
        t = np.floor(np.log(w) / r + u)
        value = np.log(c) - r * (t - u + 1)
        drawn.append((value.argmin(axis=1), t[np.arange(len(t)), value.argmin(axis=1)]))
    plain = np.mean((drawn[0][0] == drawn[1][0]) & (drawn[0][1] == drawn[1][1]))
    error = lambda n: 3 * math.sqrt(true * (1 - true) / n)
    assert abs(plain - true) < error(20_000)
    assert abs(np.mean(same) - true) < error(len(same))


def test_weighted_sampling_estimates_jaccard(spark, sf, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text, reverse=True)
    error = []
    for r in QUERIES["op7_fingerprints"](spark, sf).collect():
        a, b = Counter(words(text[r.doc_id])), Counter(words(text[order[(order.index(r.doc_id) + 1) % len(order)]]))
        error.append(r.near_next - (a & b).total() / max(1, (a | b).total()))
    assert abs(np.mean(error)) < 0.02 and np.mean(np.abs(error)) < 0.06


def test_quality(spark, odd):
    r = random.Random(4)
    make = lambda g: " ".join(("good%d" if r.random() < g / 3 else "BAD!!%d") % r.randrange(50) for _ in range(40))
    rows = [(i, make(i % 4), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    fresh = spark.createDataFrame([(i, make(i % 4)) for i in range(200)], "doc_id long, text string")
    got = quality.score(fresh, model, ["doc_id"]).collect()
    assert np.corrcoef([x.row.doc_id % 4 for x in got], [x.out.expected_grade for x in got])[0, 1] > 0.9
    assert all(list(x.out.tails) == sorted(x.out.tails, reverse=True) for x in got)
    assert quality.score(odd, model, ["doc_id"]).count() == len(ODD)
    assert quality.score(odd, quality.fit(odd, df.where("grade = 2").select("doc_id", "grade")), ["doc_id"]).first().out.expected_grade in (0.0, 2.0)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/?x=1", "<title>T</title><p>One &amp; two<br>three</p><script>no</script>"), (2, None, None), (3, "http://b/", "")]
    source = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = warc.derive(source).collect()
    assert len(made) == 6
    ids = {r.key: r.record_id for r in source.collect()}
    for r in made:
        assert r.refers_to == ids[r.key] and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
    assert next(r.block for r in made if r.key == 1 and r.record_type == "conversion") == "T\nOne & two\nthree"
    warc.write_warc(warc.derive(source), f"{tmp_path}/w")
    read = {r.headers["WARC-Record-ID"]: r.block for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert read == {r.record_id: r.block for r in made}


def test_licenses(spark, docs, odd):
    for r in licenses.scan(docs, ["doc_id", "text"]).collect():
        w = words(r.row.text)
        at = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert (r.out.n_words, r.out.n_base, r.out.base_labels) == (len(w), len(at), sorted({x[1] for x in at}))
        assert (r.out.first_word, r.out.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
    text = "Foo. Relesed undr the MIT Licence here."
    got = licenses.scan(spark.createDataFrame([(text,)], "text string"), ["text"]).first().out
    assert got.labels == ["mit"] and got.base_labels == [] and (got.spans[0].first_word, got.spans[0].last_word) == (1, 5) and 0.8 < got.score < 1
    assert licenses.scan(odd, ["doc_id"]).where("out.score > 0").count() == 0


def test_license_names_are_kept_apart(spark):
    texts = [f"Released under the {x} license." for x in ("MPL", "BSD", "GPL", "ISC", "MITT", "MIT")] + ["Subject to the terms of the mozzilla public license"]
    got = [r.out for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), ["i"]).orderBy("row.i").collect()]
    assert [x.labels for x in got] == [[], [], [], [], [], ["mit"], ["mpl"]]
    assert got[5].score == 1.0 and all(set(licenses.NAMES) <= {n[1] for n in licenses.NOTICES} and v in k for k, v in licenses.NAMES.items())


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf)
    assert 0 < out.count() < docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0

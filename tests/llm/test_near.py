"""Near copies by wide fingerprints: comparison and links against brute force, recall, large buckets, odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import simhash


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = "x%d" % r.randrange(10**6)
    return " ".join(out)


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 9), (4, 44), (2, 0)])
def test_close_pairs_equal_brute_force(words, radius):
    r = np.random.default_rng(words + radius)
    base = r.integers(0, 1 << 63, (20, words), dtype=np.uint64)
    rows, group = [], []
    for g in range(9):
        for _ in range(int(r.integers(1, 150))):
            x = base[int(r.integers(0, 20))].copy()
            for _ in range(int(r.integers(0, 2 * radius + 2))):
                x[int(r.integers(0, words))] ^= np.uint64(1) << np.uint64(r.integers(0, 64))
            rows.append(x)
            group.append(g)
    fps, group = np.array(rows), np.array(group)
    left, right = (np.concatenate(x) for x in zip(*simhash.close_pairs(fps if words > 1 else fps[:, 0], group, radius), strict=True))
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    wanted = {(i, j) for i, j in zip(*np.nonzero((far <= radius) & (group[:, None] == group[None])), strict=True) if i < j}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == wanted and len(wanted) > 20


def test_majority_counts_long_runs():
    r = np.random.default_rng(3)
    counts = np.array([1, 2, 254, 255, 256, 700, 3])
    h = r.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(3)
    lo = 0
    for n, got in zip(counts, simhash._majority(h, counts).tolist(), strict=True):
        assert got == sum((2 * sum(int(x) >> b & 1 for x in h[lo : lo + n]) > n) << b for b in range(64))
        lo += n


@pytest.mark.parametrize("bucket", [1024, 8])
def test_wide_finds_near_copies_and_leaves_others(spark, bucket):
    r = random.Random(bucket)
    vocabulary = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(40, 400))]
        texts += [" ".join(words)] + [edited(r, words, max(1, len(words) // r.choice([60, 90]))) for _ in range(r.choice([0, 1, 2, 30]))]
    texts += [edited(r, texts[0].split(), len(texts[0].split()) // 8) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("*", *simhash.text_hashes("doc_id", "text"))
    root = {x.row.doc_id: x.component_id for x in simhash._rooted(docs, ["doc_id", "h0", "h1"], "text", "doc_id", wide=simhash.Wide(bucket=bucket)).collect()}
    sets = [shingles(t) for t in texts]
    near = far = caught = merged = 0
    partner = set()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both == 0:
                assert root[i] != root[j] or both, (i, j)
            like = both / len(sets[i] | sets[j])
            if like >= 0.8 and root[i] == root[j]:
                partner |= {i, j}
            near, caught = near + (like >= 0.8), caught + (like >= 0.8 and root[i] == root[j])
            far, merged = far + (0 < like < 0.5), merged + (0 < like < 0.5 and root[i] == root[j])
    assert near > 500 and caught / near >= 0.95 and merged <= 0.01 * far
    assert all(i in partner for i in root if root[i] != i)


def test_deduplicate_wide_keeps_one_of_each_group(spark):
    r = random.Random(8)
    words = ["w%d" % r.randrange(500) for _ in range(150)]
    rows = [(9, " ".join(words)), (4, edited(r, words, 1)), (4, edited(r, words, 1)), (7, edited(r, words, 1)), (1, None), (2, ""), (3, " \n"), (5, "one two"), (6, "ONE two"), (8, "one three"), (None, "no id"), (None, "no id"), (11, "été " * 30000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, k0 int")
    kept = simhash.deduplicate(docs, wide=simhash.Wide())
    assert kept.dtypes == docs.dtypes
    assert Counter(x.doc_id for x in kept.collect()) == Counter([4, 1, 5, 8, None, 11])
    assert simhash.deduplicate(docs.where("false"), wide=simhash.Wide()).count() == 0

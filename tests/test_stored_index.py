"""The index is counted row by row and once; completions hold ids alone."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import catalog as ca
from folioforge.operators import index as ix

TEXTS = ["Café déjà-vu 123", "הספר ספר והספר", "İstanbul ΟΔΟΣ straße ﬁn", "a\u0085b\u000bc\u001cd", None, "", "x" * 9 + " y ½ ² Ⅷ", "o'neil “q” ́e"]


def _books(spark):
    rows = [(i, t, "Ann é" if i % 2 else None, "הסוג", "", "", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, title string, author string, category string, year string, city string, source string")


def test_counts_equal_those_of_the_tokens(spark):
    books = _books(spark)
    wanted, weight = Counter(), Counter()
    for r in ix.postings(books).collect():
        wanted[r.id, r.term] += 1
        weight[r.id, r.term] += r.weight
    got = ix.build(books).terms.collect()
    assert {(r.id, r.term): (r.n, r.weight) for r in got} == {k: (n, weight[k]) for k, n in wanted.items()} and len(got) == len(wanted)


def test_texts_taken_whole_give_the_terms_of_their_tokens():
    r = random.Random(3)
    letters = "abcXYZéÉß'\"-_.,+$ \t  ﬁ½²ⅧİΣσςÅ가ー漢字١①☃𝔘𐐀Ńøæ\u0301\u05b0הוש\u0345ǅ\x85\x1c\x0b\u3000"
    texts = [None, "", "ΑΣ ΑΣ.Β", *["".join(r.choice(letters) for _ in range(r.choice([3, 9, 200]))) for _ in range(2000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(texts[::-1]), pa.array([None] * len(texts), pa.string())], names=["id", "title", "author", "category"])
    got = {(i, t): (w, n) for b in ix._counted(iter([batch])) for i, t, w, n in zip(*b.to_pydict().values(), strict=True)}
    wanted = {}
    for i, row in enumerate(zip(texts, texts[::-1], strict=True)):
        for text, weight in zip(row, (10.0, 4.0), strict=True):
            tokens, stripped = tx.expanded_tokens(text)
            for term in [term for token in [*tokens, *stripped] for term in tx.index_terms(token)]:
                w, n = wanted.get((i, term), (0.0, 0))
                wanted[i, term] = (w + weight, n + 1)
    assert got == wanted


def test_equal_short_texts_are_folded_once(monkeypatch):
    """As most authors, categories and names of a catalog are."""
    seen = []
    monkeypatch.setattr(ix, "folded", lambda x: seen.append(x) or tx.folded(x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(["blue ring", "old plate", "red bolt"] * 300), pa.array(["Brand#1"] * 900), pa.array(["LARGE"] * 900)], names=["id", "title", "author", "category"])
    assert sum(b.num_rows for b in ix._counted(iter([batch]))) == 900 * 5 and len(seen) == 5


def test_blocks_are_added_to_the_stored_index(spark, monkeypatch):
    from folioforge import queries

    built = []
    monkeypatch.setattr(ix, "build", lambda *a, f=ix.build, **b: built.extend([1] if b.get("once") else []) or f(*a, **b))
    monkeypatch.setattr(queries, "_stored", {})
    plain = queries.catalog(spark, "/root/testdata/sf0.001")
    ranked = queries.catalog(spark, "/root/testdata/sf0.001", ranked=True)
    assert len(built) == 1 and plain.folder == ranked.folder and ranked.ranked().totals.count() == 1


def test_saving_folds_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    books = _books(spark)
    ca.Catalog(books.select("*").mapInArrow(count, books.schema)).save(f"{tmp_path}/c")
    assert seen.value <= 4 * len(TEXTS)  # the stored rows (sampled, then written), the terms and the number of rows


def test_completions_hold_no_texts(spark, tmp_path):
    c = ca.Catalog(_books(spark)).save(f"{tmp_path}/c", ranked=True)
    assert c.ranked().completions.columns == ["prefix", "rank", "score", "id"]
    prefixes = {r.prefix: r.df for r in c.ranked().prefixes.collect()}
    own = c.index.terms.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.char_length("term"))), lambda n: F.substring("term", F.lit(1), n))).alias("p")).distinct()
    assert prefixes == {r.p: r["count"] for r in own.groupBy("p").count().collect()}

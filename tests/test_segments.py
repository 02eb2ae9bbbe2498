"""Deltas against a full rebuild: contents, bytes written, number of segments, readers of older versions."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators import catalog as ca
from folioforge.operators import index as ix
from folioforge.operators import search as se
from folioforge.operators import segments as sg

COLUMNS = "id long, title string, author string, year string, city string, category string, source string"


def books(spark, rows):
    return spark.createDataFrame([(i, t, "a", "", "", c, "s") for i, t, c in rows], COLUMNS)


def test_batches_equal_a_rebuild(spark, tmp_path):
    r, now, path = random.Random(2), {}, f"{tmp_path}/c"
    for batch in range(6):
        ids = range(40) if not batch else r.sample(range(50), 6)
        rows = {i: (i, f"word{r.randrange(5)} b{batch} x", "c%d" % r.randrange(3)) for i in ids}
        gone = [] if not batch else r.sample(range(50), 4)
        version = sg.append(spark, path, books(spark, list(rows.values())), spark.createDataFrame([(i,) for i in gone], "id long"), last_id=batch)
        now = {k: v for k, v in now.items() if k not in gone} | rows
        sizes = [s.size for s in version.segments]
        assert all(a >= sg.RATIO * sum(sizes[i + 1 :]) for i, a in enumerate(sizes[:-1])) or len(sizes) == 1
    opened, whole = ca.Catalog.open(spark, path), ca.Catalog(books(spark, list(now.values())))
    for other in (opened, ca.Catalog.open(spark, path)):
        assert {(x.id, x.title) for x in other.books.collect()} == {v[:2] for v in now.values()}
        assert {tuple(x) for x in other.index.terms.select("id", "term", "weight", "n").collect()} == {tuple(x) for x in whole.index.terms.select("id", "term", "weight", "n").collect()}
        assert tuple(other.index.totals.first()) == tuple(whole.index.totals.first()) and other.last_id() == 5
    got, wanted = (se.search(c.index, c.books, "word1 b").select("id", F.round("score", 9)).collect() for c in (opened, whole))
    assert [tuple(x) for x in got] == [tuple(x) for x in wanted]
    assert len(sg.compact(spark, path).segments) == 1
    assert {(x.id, x.title) for x in ca.Catalog.open(spark, path).books.collect()} == {v[:2] for v in now.values()}


def test_a_small_batch_writes_little_and_old_readers_stay(spark, tmp_path):
    path = f"{tmp_path}/c"
    r = random.Random(1)
    sg.append(spark, path, books(spark, [(i, " ".join("%06x" % r.randrange(1 << 24) for _ in range(8)), "c") for i in range(20_000)]))
    before, reader = store.size_of(spark, path), ca.Catalog.open(spark, path)
    sg.append(spark, path, books(spark, [(5, "new title", "c")]))
    assert store.size_of(spark, path) - before < before / 20
    for i in range(2):
        sg.append(spark, path, books(spark, [(6 + i, "more", "c")]))
    assert reader.books.where("id = 5").first().title != "new title" and reader.books.count() == 20_000
    assert ca.Catalog.open(spark, path).books.where("id = 5").first().title == "new title"
    assert len(sg.versions(spark, path)) == 3


def test_repeated_empty_and_first_batches(spark, tmp_path):
    path = f"{tmp_path}/c"
    none = sg.append(spark, path)
    assert none.n_rows == 0 and ca.Catalog.open(spark, path).books.count() == 0
    for _ in range(2):
        v = sg.append(spark, path, books(spark, [(1, "one two", "c"), (2, "", "c")]), spark.createDataFrame([(1,), (9,)], "id long"))
        assert (v.n_rows, v.n_tokens) == (2, 6)
    assert {x.id for x in ca.Catalog.open(spark, path).books.collect()} == {1, 2}


@pytest.mark.parametrize(("sizes", "at"), [([5], 0), ([100, 5], 1), ([9, 5], 0), ([100, 9, 5], 1), ([100, 50, 5, 5], 2), ([12, 5, 5], 0)])
def test_what_is_merged(sizes, at):
    assert sg.to_merge(sizes, 2.0) == at


def test_point_reads_skip_row_groups(spark, tmp_path):
    """An id that is not there, though between the smallest and the largest, reads no row; nor does such an author."""
    rows = [(2 * (i * 7919 % 60_000), f"t{i}", f"c{i % 40}") for i in range(60_000)]
    df = books(spark, rows).withColumn("author", F.concat(F.lit("a"), F.col("id").cast("string")))
    c = ca.Catalog(df, ix.build(df.limit(1))).save(f"{tmp_path}/c")

    def read(found):
        n = len(found.collect())
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return n, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    assert read(c.book(776))[0] == 1
    assert read(c.book(777)) == (0, 0)
    assert read(c.books.where("author = 'a778'"))[0] == 1
    assert read(c.books.where("author = 'a779'")) == (0, 0)

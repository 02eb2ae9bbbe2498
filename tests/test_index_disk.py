"""Building the index leaves no shuffle files, stores postings once, and keeps blocks small and in one file."""

import os
import time

import pytest
from pyspark.sql import functions as F

from folioforge.operators import catalog as ca
from folioforge.operators import index as ix
from folioforge.operators import ranked as rk
from folioforge.operators import search as se

COLUMNS = "id long, title string, author string, year string, city string, category string, source string"


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for i in range(files.size()) if (f := files.apply(i)).getName().startswith("shuffle_")}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Most ids lie together, some far away."""
    words = ["alpha", "beta", "gamma", "alps"]
    rows = [(i if i < 9000 else 10 ** (i // 1000) + i, " ".join(words[(i >> b) % 4] for b in range(0, 12, 3)) + " é" * (i % 3), "ann", "", "", "x", "s") for i in range(13_000)]
    before = shuffled(spark)
    c = ca.Catalog(spark.createDataFrame(rows, COLUMNS)).save(str(tmp_path_factory.mktemp("c")), ranked=True)
    return c, before


def test_no_shuffle_files_stay(spark, stored):
    for _ in range(50):  # they are deleted beside the job that follows
        if not (left := shuffled(spark) - stored[1]):
            break
        time.sleep(0.1)
    assert not left


def test_postings_are_stored_once(spark, stored):
    held = [t for part in ("index", "ranked") for t in os.listdir(f"{stored[0].folder}/{part}") if {"term", "id"} <= set(spark.read.parquet(f"{stored[0].folder}/{part}/{t}").columns)]
    assert held == ["terms"]


def test_blocks_are_small_and_in_one_file(stored):
    postings = stored[0].ranked().postings.select("block", "id", F.input_file_name().alias("file"))
    blocks = postings.groupBy("block").agg(F.count_distinct("id").alias("n"), F.count_distinct("file").alias("files")).collect()
    assert max(b.n for b in blocks) <= 2048 and {b.files for b in blocks} == {1} and sum(b.n for b in blocks) == 13_000


@pytest.mark.parametrize("query", ["alpha be", "gamma e", "alps"])
def test_pages_over_such_ids(stored, query):
    c = stored[0]
    got = [(x.score, x.id) for x in rk.search_top(c.ranked(), c.books, query, "", 40).withColumn("score", F.round("score", 9)).orderBy("score", "id").collect()]
    whole = se.hits(c.index, c.books, se.compile_query(query)).select("id", "score").collect()
    assert got == sorted((round(x.score, 9), x.id) for x in whole)[:40]


def test_tables_hold_what_the_terms_hold(stored):
    c = stored[0]
    n_rows, n_tokens = c.index.totals.first()
    own = c.ranked().postings
    mean = F.lit(n_tokens / n_rows)
    key = lambda df, *names: {tuple(r) for r in df.select(*names).collect()}
    blocks = own.groupBy("term", "block").agg(F.count("*").alias("n"), F.round(F.max(rk.saturation(F.col("weight"), F.col("length"), mean)), 12).alias("impact"), F.min("id").alias("least"))
    assert key(c.ranked().blocks.withColumn("impact", F.round("impact", 12)), "term", "block", "n", "impact", "least") == key(blocks, "term", "block", "n", "impact", "least")
    each = own.select("id", "block", "length", "weight", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(6), F.char_length("term"))), lambda n: F.substring("term", F.lit(1), n))).alias("prefix"))
    held = each.groupBy("id", "block", "length", "prefix").agg(F.sum("weight").alias("f"))
    starts = held.groupBy("prefix", "block").agg(F.count("*").alias("n"), F.round(F.max(rk.saturation(F.col("f"), F.col("length"), mean)), 12).alias("impact"), F.min("id").alias("least"))
    assert key(c.ranked().starts.withColumn("impact", F.round("impact", 12)), "prefix", "block", "n", "impact", "least") == key(starts, "prefix", "block", "n", "impact", "least")


def test_an_index_from_terms_stores_the_same(spark, stored, tmp_path):
    """As that of an open catalog that is saved again with other rows."""
    index = stored[0].index
    ix.Index(index.terms, index.lengths, index.totals).write(f"{tmp_path}/i")
    key = lambda df: sorted(map(tuple, df.select("id", "term", "weight", "n").collect()))
    assert key(ix.Index.read(spark, f"{tmp_path}/i").terms) == key(index.terms)


def test_rows_of_one_id_are_one(spark, tmp_path):
    rows = [(i % 40, f"alpha {'beta ' * (i % 7)}", "ann", "", "", "x", "s") for i in range(60)]
    books = spark.createDataFrame(rows, COLUMNS).repartition(5)
    c = ca.Catalog(books).save(f"{tmp_path}/c", ranked=True)
    plain = ix.build(books)
    key = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    assert key(c.index.lengths, "id", "length") == key(plain.lengths, "id", "length")
    assert key(se.scores(c.index, se.compile_query("alpha be")).withColumn("s", F.round("score", 9)), "id", "s") == key(se.scores(plain, se.compile_query("alpha be")).withColumn("s", F.round("score", 9)), "id", "s")
    assert {(r.term, r.df) for r in c.ranked().dictionary.collect()} == {(r.term, r["n"]) for r in plain.terms.groupBy("term").agg(F.count_distinct("id").alias("n")).collect()}

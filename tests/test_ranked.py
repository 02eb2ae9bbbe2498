"""Pages from blocks against pages from all matches; what is read; stored completions."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import catalog as ca
from folioforge.operators import ranked as rk
from folioforge.operators import search as se

COLUMNS = "id long, title string, author string, year string, city string, category string, source string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(7)
    common = ["alpha", "beta", "gamma", "delta", "alps", "betamax", "epsilon"]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.choice([1, 2, 3, 9, 30]))), r.choice(["ann", "bob", "alpha"]), "", "", r.choice(["x", "y"]), "s") for i in range(12_000)]
    df = spark.createDataFrame(rows, COLUMNS)
    return ca.Catalog(df).save(str(tmp_path_factory.mktemp("c")), ranked=True)


def page(found):
    return [(x.id, x.score) for x in found.select("id", F.round("score", 9).alias("score")).orderBy("score", "id").collect()]


@pytest.mark.parametrize(("query", "category"), [("alpha", ""), ("alpha be", ""), ("betamax epsilon", "x"), ("al", "y"), ("alphabet", ""), ("gamma delta alps", ""), ("nothing alpha", ""), ("betama", ""), ("!", "")])
def test_pages_equal_those_of_all_matches(stored, query, category):
    found = rk.search_top(stored.ranked(), stored.books, query, category, 20, 5)
    whole = se.hits(stored.index, stored.books, se.compile_query(query) or [], category) if se.compile_query(query) else None
    wanted = [] if whole is None else sorted(((round(x.score, 9), x.id) for x in whole.select("id", "score").collect()))[5:25]
    assert page(found) == [(i, s) for s, i in wanted]


def test_most_blocks_are_not_read(stored):
    tables = stored.ranked()
    found = rk.Search(tables, {"q": "betamax"}, 10)
    candidates, read = found.bounds.count(), found.read.count()
    assert candidates > 30 and read < candidates / 2
    part = found.found.count()
    assert part < se.scores(stored.index, se.compile_query("betamax")).count() * 0.7


def test_batches_and_frequencies(stored, spark):
    queries = {"a": "alpha be", "b": "gamma", "c": "", "d": "zzz", "e": "epsi"}
    got = rk.Search(stored.ranked(), queries, 5).top().collect()
    for q, text in queries.items():
        wanted = [] if not text else [x.id for x in se.search(stored.index, stored.books, text).select("id", F.round("score", 9).alias("s")).orderBy("s", "id").limit(5).collect()]
        assert [x.id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])] == (wanted if text else [])
    df = {r.term: r.df for r in stored.ranked().dictionary.collect()}
    assert df == {r.term: r["count"] for r in stored.index.terms.groupBy("term").count().collect()}


@pytest.mark.parametrize("query", ["a", "al", "alpha", "betama", "betamax", "x", "zz", "", "alpha b"])
def test_completions_equal_suggestions(stored, query):
    got = rk.complete(stored.ranked(), stored.index, stored.books, query, 6)
    wanted = se.suggest(stored.index, stored.books, query, 20)
    rounded = sorted((round(x.score, 9), x.id) for x in se.hits(stored.index, stored.books, se.compile_query(query)).select("id", "score").collect())[:6] if query else []
    assert [(x.score, x.id) for x in got.collect()] == rounded and got.columns == wanted.columns

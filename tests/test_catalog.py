"""Catalog behaviour on a few Hebrew rows, with FTS5 as the judge of ranking."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioforge import store
from folioforge.functions import text as tx
from folioforge.functions.highlight import highlight
from folioforge.operators import catalog as ca
from folioforge.operators import index as ix
from folioforge.operators import outcomes as oc
from folioforge.operators import search as se
from folioforge.operators import viewer as vi
from folioforge.operators import writes as wr
from folioforge.plans.query import compile_query
from folioforge.sources import responses as rs
from folioforge.streaming import ingest

# Catalog rows that results of the catalog's tests refer to.
ROWS = [
    (14763, "משנה תורה", 'הרמב"ם', "ה'תק\"פ", "ורשה", "הלכה"),
    (9780, "שולחן ערוך אורח חיים", "ר' יוסף קארו", 'שכ"ה', "ויניציאה", "הלכה"),
    (8774, "מסילת ישרים", 'הרמח"ל', 'ת"ק', "אמשטרדם", "מוסר"),
    (2865, "ברכות עם פירוש", 'רשב"י', 'ר"מ', "מנטובה", "תלמוד"),
    (3456, 'שו"ת חתם סופר', "ר' משה סופר", 'תקצ"ט', "פרשבורג", 'שו"ת'),
]


@pytest.fixture(scope="module")
def catalog(spark):
    books = spark.createDataFrame([(*r, "x") for r in ROWS], "id long, title string, author string, year string, city string, category string, source string")
    return ca.Catalog(books.persist(), ix.build(books).persist())


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("given", "wanted"), [('שו"ת חתם סופר', "שות חתם סופר"), ("רמב״ם", "רמבם"), ("בְּרֵאשִׁית", "בראשית"), ("  מסילת   ישרים ", "מסילת ישרים"), ("בית־אל", "ביתאל"), ("בית-אל", "בית אל"), ("רמב＂ם", "רמבם"), ("a b", "a b"), (None, ""), ("", "")])
def test_normalize(spark, given, wanted):
    assert one(spark, tx.normalize, given) == wanted
    assert tx.normalize_text(given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("הרמב״ם", "הרמבם רמבם"), ("ברכות", "ברכות"), ("הוא", "הוא"), ("הלכה הלכה", "הלכה הלכה לכה")])
def test_expand(spark, given, wanted):
    assert one(spark, tx.expand, given) == wanted


@pytest.mark.parametrize(
    ("query", "wanted"),
    [('רמב"ם', {14763: -1.879521}), ("הרמבם", {14763: -1.879521}), ("מס", {8774: -2.196601}), ("שולחן ערוך", {9780: -4.179536}), ("שולחן מסילת", {}), ("רכות", {}), ("ברכות", {2865: -2.196601}), ("הלכה", {14763: -0.345301, 9780: -0.288522}), ("לכה", {14763: -0.345301, 9780: -0.288522}), ('שו"ת', {3456: -2.164247})],
)
def test_search_scores(catalog, query, wanted):
    found = catalog.search(query)
    rows = found["books"].collect()
    assert [r.id for r in rows] == list(wanted) and found["total"] == len(wanted)
    for r in rows:
        assert r.score == pytest.approx(wanted[r.id], abs=1e-6)


def test_search_agrees_with_fts5(spark, catalog):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, author, category, tokenize='unicode61 remove_diacritics 2')")
    for r in ix.index_text(catalog.books).collect():
        con.execute("INSERT INTO f(rowid, title, author, category) VALUES (?, ?, ?, ?)", (r.id, r.title, r.author, r.category))
    for query in ("ר", "סופר", "משה ס", "רמבם תורה", "סופר סופר"):
        match = " AND ".join([f'"{p.term}"' + "*" * p.prefix for p in compile_query(query)])
        wanted = con.execute("SELECT rowid, bm25(f, 10.0, 4.0, 1.0) AS s FROM f WHERE f MATCH ? ORDER BY s, rowid", (match,)).fetchall()
        got = se.search(catalog.index, catalog.books, query).collect()
        assert sorted(r.id for r in got) == sorted(w[0] for w in wanted)
        for r in got:
            assert r.score == pytest.approx(dict(wanted)[r.id], abs=1e-9)


@pytest.mark.parametrize("query", ['"', "*", "AND", "NEAR(", "title:x", "' OR 1=1 --", "(((", "ב-ה"])
def test_hostile_queries_do_not_raise(catalog, query):
    catalog.search(query)["books"].collect()
    catalog.suggest(query).collect()


def test_browse_lookup_related(catalog):
    assert [r.id for r in catalog.search("")["books"].collect()] == [2865, 3456, 8774, 9780, 14763]
    assert catalog.search("", "הלכה")["total"] == 2 and catalog.search("*")["total"] == 5
    assert catalog.book(14763).first().title == "משנה תורה" and catalog.book(999999).count() == 0
    assert [r.id for r in catalog.related(14763).collect()] == [9780] and catalog.related(1).count() == 0
    assert catalog.categories().first().n == 2 and catalog.health()["total"] == 5


def test_search_many_agrees_with_search(catalog):
    batch = se.search_many(catalog.index, catalog.books, {"a": "הלכה", "b": "סופר", "c": ""}).collect()
    for q, text in (("a", "הלכה"), ("b", "סופר")):
        assert [r.id for r in sorted(batch, key=lambda r: r["rank"]) if r.query_id == q] == [r.id for r in catalog.search(text)["books"].collect()]


def test_index_round_trip_and_replacement(spark, catalog, tmp_path):
    opened = ca.Catalog(catalog.books, catalog.index).save(f"{tmp_path}/c", last_id=9)
    assert opened.search("סופר")["total"] == 1 and opened.last_id() == 9 and opened.stats()["size_mb"] >= 0
    page = json.loads(opened.search_json("סופר"))
    assert page["total"] == 1 and page["books"][0]["id"] == 3456 and not page["has_more"] and json.loads(opened.search_json("", limit=2))["has_more"]
    with pytest.raises(ca.CatalogMissing):
        ca.Catalog.open(spark, f"{tmp_path}/none")
    changed = catalog.books.where("id = 3456").withColumn("title", F.lit("אחר"))
    books = wr.upsert(catalog.books, changed.withColumn("seq", F.lit(1)))
    new = ix.replace_rows(catalog.index, books, changed)
    assert se.total(new, books, "חתם").first().total == 0 and se.total(new, books, "אחר").first().total == 1
    fresh = ix.build(books)
    assert {(r.id, r.term, r.weight) for r in new.terms.collect()} == {(r.id, r.term, r.weight) for r in fresh.terms.collect()}


@pytest.mark.parametrize(("limit", "offset"), [(0, 0), (101, 0), (10, -1)])
def test_pages_out_of_bounds_are_refused(catalog, limit, offset):
    with pytest.raises(ValueError):
        catalog.search("", limit=limit, offset=offset)
    with pytest.raises(ValueError):
        catalog.suggest("a", limit=21)


def test_failed_renames_keep_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    wr.replace_table(spark.range(3), path)
    real, calls = store.rename, []

    def second_fails(spark, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("no")
        real(spark, source, target)

    monkeypatch.setattr(store, "rename", second_fails)
    with pytest.raises(OSError):
        wr.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(store, "rename", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        wr.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_batches_publish_whole_versions(spark, tmp_path, monkeypatch):
    schema = "id long, attempt int, status int, headers map<string,string>, body binary, error string"
    page = lambda t: bytearray(PAGES["detail"].replace("זהר", t).encode())
    one_ = spark.createDataFrame([(1, 0, 200, {}, page("ראשון"), None), (2, 0, 404, {}, None, None), (3, 0, 403, {}, None, None)], schema)
    two = spark.createDataFrame([(2, 0, 200, {}, page("שני"), None), (1, 0, 200, {}, page("אחרון"), None), (9, 0, 404, {}, None, None)], schema)
    path = f"{tmp_path}/c"
    first = ingest.apply_batch(one_, path, 0)
    assert first.search("ראשון")["total"] == 1 and [r.id for r in first.misses.collect()] == [2] and first.last_id() == 3
    monkeypatch.setattr(store, "write_marker", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        ingest.apply_batch(two, path, 1)
    monkeypatch.undo()
    assert ca.Catalog.open(spark, path).search("ראשון")["total"] == 1
    for _ in range(2):
        now = ingest.apply_batch(two, path, 1)
        assert now.search("ראשון")["total"] == 0 and now.search("אחרון")["total"] == now.search("שני")["total"] == 1
        assert sorted(r.id for r in now.misses.collect()) == [2, 9] and now.last_id() == 9 and now.books.count() == 2


def test_retry_plan_and_capabilities(spark):
    rows = [(1, 0, 429, {"retry-after": "7"}), (1, 1, 429, {"retry-after": "later"}), (2, 0, 403, {}), (3, 1, 500, {}), (4, 0, None, {}), (5, 0, 404, {}), (6, 2, 500, {})]
    got = oc.retry_plan(spark.createDataFrame(rows, "id long, attempt int, status int, headers map<string,string>")).collect()
    assert [r.wait for r in got] == [7.0, 30.0, 2.0, 1.0, 0.5, None, None]
    asked = []

    def probe(id):
        asked.append(id)
        return spark.createDataFrame([(id, 200, {"x-frame-options": "DENY"} if id == 1 else {}, None)], "id long, status int, headers map<string,string>, error string")

    known = vi.Capabilities(probe)
    assert [known.of(i)[0] for i in (1, 2, 1, 2)] == [False, True, False, True] and asked == [1, 2]


@pytest.mark.parametrize(
    ("text", "query", "wanted"),
    [
        ('הרמב"ם <b>', "רמבם", 'ה<mark>רמב&quot;ם</mark> &lt;b&gt;'),
        ("abab", "ab", "<mark>abab</mark>"),
        ("abcd", "bc AB", "<mark>abc</mark>d"),
        ("x.y (z)", ". (", "x<mark>.</mark>y <mark>(</mark>z)"),
        ("בְּרֵאשִׁית ברא", "ברא", "<mark>בְּרֵא</mark>שִׁית <mark>ברא</mark>"),
        ("É é", "é", "<mark>É</mark> <mark>é</mark>"),
        (None, "a", ""),
        ("", "a", ""),
        ("a'b", "x", "a&#39;b"),
        ("a'b & c", "", "a&#39;b &amp; c"),
        ("a'b", "ab", "<mark>a&#39;b</mark>"),
    ],
)
def test_highlight(spark, text, query, wanted):
    assert one(spark, lambda c: highlight(c, query), text) == wanted


PAGES = {
    "detail": "<html><head><title>catalog.example Sefer Detail: זהר -- רשב\"י</title></head><body><table><tr><td>עיר</td><td>ורשה</td></tr><tr><td>נושא:</td><td>קבלה</td></tr></table></body></html>",
    "english": "<html><head><title>CATALOG.EXAMPLE sefer detail : Some Book --</title></head><body></body></html>",
    "legacy": "<html><head><title>העיטור - א - catalog.example</title></head><body><h2>רבי יצחק</h2></body></html>",
    "home": "<html><head><title>catalog.example home page</title></head><body>padding padding padding</body></html>",
    "other": "<html><head><title>Plain English</title></head><body>padding padding padding</body></html>",
    "blocked": "<html><head><title>Just a moment...</title></head><body>padding padding padding</body></html>",
    "untitled": "<html><body><p>padding padding padding padding padding</p></body></html>",
    "short": "<html></html>",
    "none": None,
}


def test_inspect(spark):
    df = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate(PAGES.items())], "id long, name string, html string")
    got = {r.row.name: r for r in rs.inspect(df).collect()}
    assert (got["detail"].book.title, got["detail"].book.author, got["detail"].book.city, got["detail"].book.category) == ("זהר", 'רשב"י', "ורשה", "קבלה")
    assert got["english"].book.title == "Some Book" and got["english"].book.author == ""
    assert got["legacy"].book.title == "העיטור - א" and got["legacy"].book.author == "רבי יצחק"
    assert {k: got[k].reason for k in ("home", "other", "blocked", "untitled", "short", "none")} == {"home": "dead-title", "other": "not-hebrew", "blocked": "blocked-page", "untitled": "no-title", "short": "empty-body", "none": "empty-body"}
    assert rs.describe(rs.inspect(df)).count() == len(PAGES)
    clash = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["reason", "book", "detail", "trace", "marker", "_p", "cells", "source", "row"])])
    assert {tuple(r.row)[3:] for r in rs.inspect(clash).collect()} == {tuple(range(9))}
    assert rs.inspect(df.where("false")).count() == 0


def test_page_cells_and_fields(spark):
    deep = "<div>" * 3000 + "<h1>Deep</h1>" + "</div>" * 3000
    page = (
        "<title>T</title><table><tr><td>Author<td>A<td>x<tr><td>שם הספר:</td><td>The Book</td></tr><tr><th>year<th>1900<table><tr><td>inner<td>1</table></table>"
        "<dl><dt>City<dt>Place<dd>Rome<dd>no</dl><b>Subject:</b> halakha<b>Topic:</b><i>not text</i><p><b>plain</b> no</p>" + deep
    )
    found = rs.page_cells(page)
    assert ("cell", "Author", "A") in found and ("cell", "A", "x") in found and ("term", "City", "Rome") in found and ("term", "Place", "Rome") in found
    assert ("bold", "Subject:", " halakha") in found and not any(k == "bold" and l == "Topic:" for k, l, _ in found) and ("h1", "", "Deep") in found
    df = spark.createDataFrame([(1, page)], "id long, html string")
    r = df.select(rs.candidates(rs.cells(F.col("html"))).alias("c"), rs.fields(rs.cells(F.col("html")), rs.FIELD_LABELS).alias("f")).first()
    assert [(x.source, x.text) for x in r.c] == [("<title>", "T"), ("<h1>", "Deep"), ("table:title", "The Book")]
    assert (r.f.author, r.f.city, r.f.category) == ("A", "Rome", "halakha") and r.f.year.startswith("1900")


@pytest.mark.parametrize(("raw", "kind", "wanted"), [("שלום".encode("cp1255"), "text/html; charset=windows-1255", "שלום"), ("שלום".encode("cp1255"), None, "שלום"), ("שלום".encode(), "text/html", "שלום"), ("é".encode("latin1"), 'x; charset="ISO-8859-1"; y', "é"), ("é".encode(), "charset=nonsense", "é"), (b"", "", ""), (None, None, ""), (b"\xff\xd9\xfc", "charset=utf-8", None)])
def test_decode_body(spark, raw, kind, wanted):
    got = spark.createDataFrame([(raw and bytearray(raw), kind)], "b binary, k string").select(rs.decode_body(F.col("b"), F.col("k")).alias("t")).first().t
    assert got == wanted if wanted is not None else "\ufffd" in got


def test_classify(spark):
    ok = PAGES["detail"]
    rows = [(1, 0, 500, {}, None, None), (1, 1, 200, {"content-type": "text/html; charset=windows-1255"}, bytearray(ok.encode("cp1255")), None), (2, 0, 404, {}, None, None), (3, 0, 403, {}, bytearray(PAGES["blocked"].encode()), None), (4, 0, None, None, None, "read timeout"), (5, 0, 418, {}, None, None), (6, 0, 429, {}, None, None), (7, 0, 403, {}, None, None)]
    df = spark.createDataFrame(rows, "id long, attempt int, status int, headers map<string,string>, body binary, error string")
    got = {r.id: r for r in rs.classify(df).collect()}
    assert {k: v.reason for k, v in got.items()} == {1: "ok", 2: "http-404", 3: "challenge", 4: "timeout", 5: "http-other", 6: "http-429", 7: "http-403"}
    assert got[1].book.title == "זהר"


def _loop(reasons, threshold, sample):
    from folioforge.schema import HARD

    seen = hard = run = found = 0
    for i, r in enumerate(reasons):
        seen, found = seen + 1, found + (r == "ok")
        hard, run = (hard + 1, run + 1) if r in HARD else (hard, 0)
        if run >= threshold or (seen >= sample and not found and hard / seen > 0.8):
            return i
    return None


def test_breaker_batch_equals_loop(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        reasons = [r.choice(["ok", "http-403", "http-403", "http-404"] if seed < 3 else ["http-403"] * 9 + ["http-404"]) for _ in range(400)]
        df = spark.createDataFrame([(i, i, x, "") for i, x in enumerate(reasons)], "seq long, id long, reason string, detail string")
        for t in (5, 25):
            got = oc.trip(df, threshold=t, sample=60, chunk_rows=7).collect()
            assert (got[0].seq if got else None) == _loop(reasons, t, 60)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_throttle_equals_loop(spark, chunk):
    import random

    r = random.Random(3)
    log = [(i, r.choice("abc"), r.choice(["ok", "http-403", "http-404"] if i // 150 % 2 else ["ok", "ok", "http-403"])) for i in range(900)] + [(i, "d", "http-403") for i in range(2000)] + [(2000 + i, "d", "ok") for i in range(9)]
    wanted = {}
    for _, worker, reason in log:
        d = wanted.get(worker, 0.15)
        wanted[worker] = min(8.0, max(0.25, 2 * d)) if reason == "http-403" else max(0.15, d * 0.9)
    r.shuffle(log)
    df = spark.createDataFrame(log, "seq long, worker string, reason string")
    assert {x.worker: x.delay for x in oc.throttle(df, chunk_rows=chunk).collect()} == pytest.approx(wanted)


def test_stream_progress(spark, tmp_path):
    rows = [("r", i, "http-403" if i % 10 else "ok", f"2024-01-01 00:00:{i:02d}") for i in range(50)]
    df = spark.createDataFrame(rows, "run string, seq long, reason string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ingest.stream_progress(stream).writeStream.format("memory").queryName("p").outputMode("complete").option("checkpointLocation", f"{tmp_path}/p").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.window_start), r.processed) for r in spark.table("p").collect()) == sorted((str(r.window_start), r.processed) for r in oc.progress(df).collect())


def test_upsert_checkpoint_and_pending(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 1)], "id long, v string, seq long")
    assert {(r.id, r.v) for r in wr.upsert(old, new).collect()} == {(1, "a"), (2, "d"), (3, None)}
    wr.set_checkpoint(spark, f"{tmp_path}/s", 7)
    wr.set_checkpoint(spark, f"{tmp_path}/s", 9)
    assert wr.get_checkpoint(spark, f"{tmp_path}/s") == 9
    assert [r.id for r in oc.pending_ids(spark, 1, 4, old.select("id")).orderBy("id").collect()] == [3, 4]
    wr.compact(old, f"{tmp_path}/t", 2)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    empty = oc.verdict(spark.createDataFrame([], "seq long, id long, reason string, detail string")).first()
    assert empty.exit_code == 0 and empty.processed == 0

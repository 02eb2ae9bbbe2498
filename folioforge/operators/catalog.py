"""Reads of the catalog, and the class that bundles them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators import index as ix
from folioforge.operators import ranked as rk
from folioforge.operators import search as se
from folioforge.operators import segments as sg
from folioforge.operators import writes as wr
from folioforge.schema import MISSES, STATE

#: Parquet options of the stored books: lookups by id and author skip the row groups whose Bloom filter says no.
BLOOM = {"compression": "zstd", "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.enabled#author": "true"}


class CatalogMissing(Exception):
    """There is no catalog at the path."""


def lookup(books: DataFrame, id: int, viewer: str = "https://example.org/{id}", pdf: str = "https://example.org/pdf/{id}", proxy: bool = False) -> DataFrame:
    """The row with the id, its links, and the proxy's link or null."""
    link = lambda t: F.concat(F.lit(t.split("{id}")[0]), F.col("id").cast("string"), F.lit(t.split("{id}", 1)[1]))
    return books.where(F.col("id") == id).select("id", "title", "author", "year", "city", "category", "source", link(viewer).alias("viewer_url"), link(pdf).alias("pdf_url"), (F.concat(F.lit("/api/read/"), F.col("id").cast("string")) if proxy else F.lit(None).cast("string")).alias("proxy_url"))


def related(books: DataFrame, id: int, limit: int = 8) -> DataFrame:
    """Rows by the same author, then of the same category and another author, each by id.

    An unknown id relates to nothing; an empty author or category matches nothing.
    """
    one = F.broadcast(books.where(F.col("id") == id).orderBy("id").limit(1).select(F.col("id").alias("own_id"), F.col("author").alias("own_author"), F.col("category").alias("own_category")))
    others = books.join(one, F.col("id") != F.col("own_id"))
    same = (F.col("author") == F.col("own_author")) & (F.col("author") != "")
    near = (F.col("category") == F.col("own_category")) & (F.col("category") != "") & (F.col("author") != F.col("own_author"))
    rows = others.where(same | near).select("id", "title", "author", "year", "category", F.when(same, 0).otherwise(1).alias("prio"))
    return rows.orderBy("prio", "id").limit(limit)


def histogram(books: DataFrame, k: int = 24) -> DataFrame:
    """Largest categories first, ties by name; empty ones are left out."""
    return books.where(F.col("category") != "").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)


def chips(books: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` largest categories behind a row for all."""
    head = books.agg(F.lit("").alias("category"), F.count("*").alias("n"))
    return head.withColumn("prio", F.lit(0)).unionByName(histogram(books, k).withColumn("prio", F.lit(1)))


def check_page(limit: int, offset: int = 0, most: int = 100) -> None:
    """The public reads' bounds: a limit of 1 to ``most`` and no negative offset, else ValueError."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}: {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative: {offset}")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, in the rows' order; null fields stay, as clients expect them."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


class Catalog:
    """An open catalog: the tables, the index, and the public reads.

    On disk it is a folder of versions: whole ones (``save``), each with books, misses, state and the index, or
    lists of segments (``segments.append``). Either way what a reader opens fits together.
    """

    def __init__(self, books: DataFrame, index: ix.Index | None = None, misses: DataFrame | None = None, folder: str | None = None, version: sg.Version | None = None):
        self.books, self.index, self.misses, self.folder, self.version = books, index or ix.build(books), misses, folder, version
        self.unbuilt = index is None

    @staticmethod
    def open(spark: SparkSession, path: str, name: str | None = None) -> Catalog:
        """The newest published version, or the named one."""
        done = store.published(spark, path)
        if not done:
            raise CatalogMissing(f"no catalog at {path}")
        if store.read_marker(spark, path, name or done[-1]):
            version = sg.load(spark, path, name)
            t = sg.tables(spark, path, version)
            return Catalog(t["books"], ix.Index(t["terms"], t["lengths"], t["totals"]), t["misses"], version=version)
        folder = f"{path}/versions/{name or done[-1]}"
        return Catalog(spark.read.parquet(f"{folder}/books"), ix.Index.read(spark, f"{folder}/index"), spark.read.parquet(f"{folder}/misses"), folder)

    def save(self, path: str, last_id: int = 0, ranked: bool = False, completions: bool | None = None) -> Catalog:
        """Publishes the tables as the path's new version: books by category, then author, which keeps the row
        groups of equality filters few, with a Bloom filter on id and author; the index by term. The number of
        files follows the tables' size. ``ranked`` adds the blocks of ``ranked``, and the completions unless these are
        left out; ``complete`` adds them later."""
        spark = self.books.sparkSession
        misses = self.misses if self.misses is not None else spark.createDataFrame([], MISSES)
        state = spark.createDataFrame([("last_id", str(last_id))], STATE).coalesce(1)
        books = self.books.repartitionByRange("category", "author", "id").sortWithinPartitions("category", "author", "id")

        def rest(folder: str) -> None:
            stored = spark.read.parquet(f"{folder}/books")
            (ix.build(stored, once=True, path=f"{folder}/index/rows") if self.unbuilt else self.index).write(f"{folder}/index")
            if ranked:
                rk.write(spark, folder)
                if completions is not False:
                    rk.write_completions(spark, folder)

        with store.swept(spark):
            store.publish({"books": books, "misses": misses, "state": state}, path, prepare=rest, options={"books": BLOOM})
        return Catalog.open(spark, path)

    def ranked(self) -> rk.Blocks:
        """The stored blocks and completions."""
        return rk.Blocks.read(self.books.sparkSession, self.folder)

    def rank(self) -> None:
        """Stores the blocks beside the index unless they are there."""
        if not store.exists(self.books.sparkSession, f"{self.folder}/ranked/totals/_SUCCESS"):
            rk.write(self.books.sparkSession, self.folder)

    def complete(self) -> None:
        """Stores the completions beside the blocks unless they are there."""
        if self.ranked().completions is None:
            rk.write_completions(self.books.sparkSession, self.folder)

    def last_id(self) -> int:
        if self.version:
            return self.version.last_id
        return wr.get_checkpoint(self.books.sparkSession, f"{self.folder}/state") if self.folder else 0

    def search(self, query: str = "", category: str = "", limit: int = 30, offset: int = 0) -> dict:
        """The response envelope; the page is a DataFrame."""
        check_page(limit, offset)
        count = se.total(self.index, self.books, query, category).first().total
        return {"books": se.search(self.index, self.books, query, category, limit, offset), "total": count, "limit": limit, "offset": offset, "query": query, "category": category, "has_more": offset + limit < count}

    def search_json(self, query: str = "", category: str = "", limit: int = 30, offset: int = 0) -> str:
        """The envelope as JSON text; a page has at most 100 rows."""
        found = self.search(query, category, limit, offset)
        rows = [json.loads(r.json) for r in as_json(found["books"]).collect()]
        return json.dumps(found | {"books": rows}, ensure_ascii=False)

    def suggest(self, query: str, limit: int = 8) -> DataFrame:
        check_page(limit, most=20)
        return se.suggest(self.index, self.books, query, limit)

    def book(self, id: int, **links) -> DataFrame:
        return lookup(self.books, id, **links)

    def related(self, id: int, limit: int = 8) -> DataFrame:
        return related(self.books, id, limit)

    def categories(self) -> DataFrame:
        return histogram(self.books)

    def stats(self) -> dict:
        """Totals of books, misses and categories, and the size on disk in MB."""
        spark = self.books.sparkSession
        held = sum(s.size for s in self.version.segments) if self.version else store.size_of(spark, self.folder) if self.folder else None
        size = None if held is None else round(held / 1e6, 1)
        return {"total": self.books.count(), "misses": self.misses.count() if self.misses is not None else 0, "categories": [(r.category, r.n) for r in self.categories().collect()], "size_mb": size, "last_id": self.last_id()}

    def health(self) -> dict:
        return {"ok": True, "total": self.books.count()}

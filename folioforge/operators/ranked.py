"""Ranked search that reads the blocks which can reach the page, and stored completions of short prefixes.

Rows are grouped into blocks of similar length and neighbouring ids, as the index stores them. Beside the
postings, which are the index's, there is a table of the largest share that a term can add to a score
inside each block, and a dictionary with every term's document frequency. A
search sums these shares to a bound for each block that holds all its words,
reads the few best blocks, and then only those whose bound reaches the last
score of the page found so far. The page is that of ``search``.

For every prefix of up to ``PREFIX`` characters there are the number of rows
that it occurs in and its best ``COMPLETIONS`` rows in order, so a suggestion is
a lookup. All tables are plain Parquet, sorted so that filters skip pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge import store
from folioforge.operators.index import STORED, Index, blocked, told_apart
from folioforge.operators.search import IDF_FLOOR, K1, NAMED, SEARCH_COLUMNS, SMALL, SUGGEST_COLUMNS, B, reach, suggest
from folioforge.plans.query import clamp, compile_query

PREFIX, COMPLETIONS = 6, 20
#: Blocks of each query that are read first.
FIRST = 4
#: Rows, and their terms, whose prefixes are cut at a time.
_ROWS, _TERMS = 256, 200_000
#: More than the arithmetic of a bound can lose.
SLACK = 1e-11
#: Parts in which the rows of a hot prefix or query are ranked first.
SALTS = 32
TABLES = ("dictionary", "blocks", "starts", "prefixes", "totals")


def saturation(f, length, mean):
    """The share of BM25 that does not depend on the word, of columns or arrays."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def idf_of(df: Column, n_rows: Column) -> Column:
    ratio = (n_rows - df + 0.5) / (df + 0.5)
    return F.when(F.ln(ratio) > 0, F.ln(ratio)).otherwise(IDF_FLOOR)


def best_first(rows: DataFrame, by: str, order: list[Column | str], k: int | Column) -> DataFrame:
    """``rank`` and the first ``k`` rows of each ``by``; hot ones are cut down in ``SALTS`` parts first."""
    salt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    near = salt.withColumn("rank", F.row_number().over(Window.partitionBy(by, "salt").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k).drop("salt")


@dataclass
class Blocks:
    dictionary: DataFrame  # term, df
    blocks: DataFrame  # term, block, n, impact, least (the smallest id)
    starts: DataFrame  # the same for prefixes: prefix, block, n, impact, least
    postings: DataFrame  # term, block, id, weight, length
    prefixes: DataFrame  # prefix, df
    totals: DataFrame  # n_rows, n_tokens
    completions: DataFrame | None = None  # prefix, rank, score, id; None where they are not stored

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Blocks:
        """Those of a catalog's stored version."""
        path = f"{folder}/ranked"
        dictionary, blocks, starts, prefixes, totals = [spark.read.parquet(f"{path}/{t}") for t in TABLES]
        postings = spark.read.parquet(f"{folder}/index/terms").select("term", "block", "id", "weight", "length")
        done = store.exists(spark, f"{path}/completions/_SUCCESS")
        return Blocks(dictionary, blocks, starts, postings, prefixes, totals, spark.read.parquet(f"{path}/completions") if done else None)


def _put(df: DataFrame, path: str) -> None:
    df.write.options(**STORED).mode("overwrite").parquet(path)


def _pieces(batch: pa.RecordBatch, apart: str | None = None) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, all with the same value of ``apart``."""
    held = pc.list_value_length(batch["weights"]).to_numpy()
    changes = batch[apart].to_numpy() if apart else None
    lo, terms = 0, 0
    for i in range(batch.num_rows):
        if i > lo and (i - lo == _ROWS or terms + held[i] > _TERMS or changes is not None and changes[i] != changes[i - 1]):
            yield batch.slice(lo, i - lo)
            lo, terms = i, 0
        terms += held[i]
    if batch.num_rows > lo:
        yield batch.slice(lo)


def _prefixed(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Over the index's rows, for each length of a prefix: the places of the rows, their prefixes, and the weight of each."""
    terms = pc.split_pattern(rows["terms"], " ")
    at, weight = pc.list_parent_indices(terms).to_numpy(), pc.list_flatten(rows["weights"]).to_numpy()
    terms = pc.list_flatten(terms)
    size = pc.utf8_length(terms).to_numpy()
    for n in range(1, PREFIX + 1):
        long = np.flatnonzero(size >= n)
        if not len(long):
            break
        prefix, row = pc.utf8_slice_codeunits(terms.take(pa.array(long)), 0, n), at[long]
        new = np.ones(len(long), dtype=bool)  # a row's terms are sorted
        new[1:] = (row[1:] != row[:-1]) | pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        yield row[first], prefix.take(pa.array(first)), np.add.reduceat(weight[long], first)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the index's rows: id, prefix, f, length of every row's prefixes."""
    for batch in batches:
        for rows in _pieces(batch):
            for at, prefix, f in _prefixed(rows):
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([rows["id"].take(where), prefix, pa.array(f), rows["length"].take(where)], names=["id", "prefix", "f", "length"])


def _started(mean: float):
    """Over the index's rows sorted by block: prefix, block, n, impact, least, once for each prefix of a block."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("prefix").aggregate([("n", "sum"), ("impact", "max"), ("least", "min")])
        return pa.table([found[c] for c in ("prefix", "n_sum", "impact_max", "least_min")], names=["prefix", "n", "impact", "least"])

    def made(block: int | None, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if parts:
            found = summed(parts)
            yield from found.add_column(1, "block", pa.array(np.full(found.num_rows, block))).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            for rows in _pieces(batch, "block"):
                ids, length = rows["id"], rows["length"].to_numpy()
                if block != (own := rows["block"][0].as_py()):
                    yield from made(block, parts)
                    block, parts = own, []
                for at, prefix, f in _prefixed(rows):
                    parts.append(pa.table([prefix, pa.array(np.ones(len(at), dtype=np.int64)), pa.array(saturation(f, length[at], mean)), ids.take(pa.array(at))], names=["prefix", "n", "impact", "least"]))
                parts = [summed(parts)]
        yield from made(block, parts)

    return work


def write(spark: SparkSession, folder: str) -> None:
    """Builds the tables beside the index of a catalog's stored version. Rows move as wholes, once for terms and once for
    prefixes; what is counted of a block is counted in one task."""
    index = Index.read(spark, f"{folder}/index")
    n_rows, n_tokens = index.totals.first()
    mean = n_tokens / n_rows if n_rows and n_tokens else 1.0
    put = lambda df, name: _put(df, f"{folder}/ranked/{name}")
    of = lambda name: spark.read.parquet(f"{folder}/ranked/{name}")
    kind = index.rows.schema["id"].dataType.simpleString()
    with store.swept(spark):
        near = blocked(index.rows)
        each = told_apart(near, "block", "length")
        put(each.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(saturation(F.col("weight"), F.col("length"), F.lit(mean))).alias("impact"), F.min("id").alias("least")).sortWithinPartitions("term", "block"), "blocks")
        put(of("blocks").groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), "dictionary")
        put(near.drop("ns").sortWithinPartitions("block").mapInArrow(_started(mean), f"prefix string, block long, n long, impact double, least {kind}").sortWithinPartitions("prefix", "block"), "starts")
        put(of("starts").groupBy("prefix").agg(F.sum("n").alias("df")).repartitionByRange("prefix").sortWithinPartitions("prefix"), "prefixes")
        put(index.totals.coalesce(1), "totals")


def write_completions(spark: SparkSession, folder: str) -> None:
    """Adds the best rows of each prefix to the stored tables: ids alone, as a text stands in as many lists as it has prefixes."""
    tables, rows = Blocks.read(spark, folder), Index.read(spark, f"{folder}/index").rows
    n_rows, n_tokens = tables.totals.first()
    mean = F.lit(n_tokens / n_rows if n_rows and n_tokens else 1.0)
    score = F.round(-idf_of(F.col("df"), F.lit(n_rows)) * saturation(F.col("f"), F.col("length"), mean), 9)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = rows.mapInArrow(_held, f"id {kinds['id']}, prefix string, f double, length long")
    scored = held.join(tables.prefixes, "prefix").select("prefix", "id", score.alias("score"))
    best = best_first(scored, "prefix", ["score", "id"], COMPLETIONS)
    with store.swept(spark):
        _put(best.select("prefix", "rank", "score", "id").repartitionByRange("prefix").sortWithinPartitions("prefix", "rank"), f"{folder}/ranked/completions")


def complete(tables: Blocks, index: Index, books: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """As ``suggest`` (scores rounded to nine places), read from the stored completions where the text is one
    word of at most ``PREFIX`` characters."""
    phrases, limit = compile_query(text), clamp(limit, COMPLETIONS)
    if tables.completions is not None and phrases and len(phrases) == 1 and phrases[0].prefix and 0 < len(phrases[0].term) <= PREFIX:
        found = tables.completions.where((F.col("prefix") == phrases[0].term) & (F.col("rank") <= limit))
        ids = [r.id for r in found.select("id").collect()]
        return found.join(books.where(F.col("id").isin(ids)).select(*SUGGEST_COLUMNS), "id").select(*SUGGEST_COLUMNS, "score").orderBy("score", "id")
    return suggest(index, books, text, limit).withColumn("score", F.round("score", 9)).orderBy("score", "id")


class Search:
    """One or many ranked queries in one run; ``bounds`` and ``read`` tell which blocks could matter and which were read."""

    def __init__(self, tables: Blocks, queries: dict[str, str], k: int = 10, rows: DataFrame | None = None, first: int = FIRST):
        """``rows``: the ids that may be found (all if None), such as those of a category."""
        self.tables, self.k, self.rows = tables, k, rows
        spark = tables.postings.sparkSession
        wanted = [(q, i, p.term, p.prefix, len(ps)) for q, raw in queries.items() if (ps := compile_query(raw)) for i, p in enumerate(ps)]
        self.words = {(w, prefix) for _, _, w, prefix, _ in wanted if w}
        phrases = spark.createDataFrame(wanted, "query_id string, phrase int, word string, prefix boolean, needed int").where("word <> ''")
        self.phrases = F.broadcast(phrases) if len(wanted) <= SMALL else phrases
        self.matched = self._matched()
        local = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema)) if len(rows) <= SMALL else spark.createDataFrame(rows, schema)
        # a row for each phrase, or a few for each query, that the caller gave
        self.weights = local(self._weights().collect(), "query_id string, phrase int, idf double, mean double")
        self.bounds = store.cut(self._bounds())
        begun = best_first(self.bounds.withColumnRenamed("block", "id"), "query_id", [F.desc("bound"), "least"], first)
        self.begun = local(begun.select("query_id", "id").collect(), "query_id string, block long")
        scored = store.cut(self._scored(self.begun))
        last = best_first(scored, "query_id", ["rounded", "id"], k).groupBy("query_id").agg(F.count("*").alias("found"), F.max(F.struct("rounded", "id")).alias("x"))
        ends = local([(r.query_id, -r.x.rounded, r.x.id) for r in last.collect() if r.found >= k], "query_id string, reach double, last long")
        # of rows that tie with the last one of the page only those of smaller ids come before it
        most = F.round("bound", 9)
        could = F.col("reach").isNull() | (most > F.col("reach")) | ((most == F.col("reach")) & (F.col("least") < F.col("last")))
        rest = self.bounds.join(self.begun, ["query_id", "block"], "left_anti").join(ends, "query_id", "left").where(could).select("query_id", "block")
        few = rest.limit(SMALL + 1).collect()
        self.rest = local(few, "query_id string, block long") if len(few) <= SMALL else store.cut(rest)
        self.read = self.begun.unionByName(self.rest)
        self.found = scored.unionByName(self._scored(self.rest)) if few else scored

    def top(self) -> DataFrame:
        """query_id, rank, id, score (rounded to nine places) of each query's best rows."""
        return best_first(self.found, "query_id", ["rounded", "id"], self.k).select("query_id", "rank", "id", F.col("rounded").alias("score"))

    def _matched(self) -> DataFrame:
        """query_id, phrase, needed, term and its df: which terms stand for which words."""
        return self._standing(self.tables.dictionary).select("query_id", "phrase", "needed", "term", "df", "word", "prefix")

    def _standing(self, rows: DataFrame) -> DataFrame:
        """The rows whose term stands for a word, once for each phrase with it; they are not moved while the phrases are few."""
        near = rows.where(reach("term", self.words))
        lengths = sorted({len(w) for w, prefix in self.words if prefix})
        cut = F.array(*[F.struct(F.lit(True).alias("prefix"), F.substring("term", 1, n).alias("word")) for n in lengths], F.struct(F.lit(False).alias("prefix"), F.col("term").alias("word")))
        each = near.select(*rows.columns, F.explode(F.array_distinct(cut)).alias("x")).select(*rows.columns, "x.prefix", "x.word")
        return each.join(self.phrases, ["word", "prefix"])

    def _weights(self) -> DataFrame:
        """query_id, phrase, idf and the mean length; frequencies come from the dictionary and the prefix table, and
        only those of longer prefixes of several terms are counted."""
        plain = self.matched.where("NOT prefix").select("query_id", "phrase", "df")
        short = self.phrases.where(F.col("prefix") & (F.char_length("word") <= PREFIX)).join(self.tables.prefixes.withColumnRenamed("prefix", "word").where(reach("word", {(w, False) for w, p in self.words if p})), "word").select("query_id", "phrase", "df")
        df = plain.unionByName(short)
        long = {(w, p) for w, p in self.words if p and len(w) > PREFIX}
        if long:
            terms = self.matched.where(F.col("prefix") & (F.char_length("word") > PREFIX)).select("query_id", "phrase", "term")
            df = df.unionByName(self.tables.postings.where(reach("term", long)).join(F.broadcast(terms) if len(long) <= NAMED else terms, "term").groupBy("query_id", "phrase").agg(F.count_distinct("id").alias("df")))
        return df.crossJoin(F.broadcast(self.tables.totals)).select("query_id", "phrase", idf_of(F.col("df"), F.col("n_rows")).alias("idf"), (F.col("n_tokens") / F.col("n_rows")).alias("mean"))

    def _bounds(self) -> DataFrame:
        """query_id, block, bound and a smallest id of the blocks that hold all words of a query."""
        plain = {(w, p) for w, p in self.words if not p or len(w) > PREFIX}
        short = {(w, False) for w, p in self.words if p and len(w) <= PREFIX}
        named = self.matched.where("NOT prefix OR char_length(word) > %d" % PREFIX).select("query_id", "phrase", "needed", "term")
        own = self.tables.blocks.where(reach("term", plain) if plain else F.lit(False)).join(named, "term").select("query_id", "needed", "phrase", "block", "impact", "least")
        starts = self.tables.starts.where(reach("prefix", short) if short else F.lit(False)).withColumnRenamed("prefix", "word")
        begin = starts.join(self.phrases.where(F.col("prefix")), "word").select("query_id", "needed", "phrase", "block", "impact", "least")
        shares = own.unionByName(begin).groupBy("query_id", "needed", "phrase", "block").agg(F.least(F.sum("impact"), F.lit(K1 + 1)).alias("share"), F.min("least").alias("least"))
        bound = F.sum(F.col("idf") * F.col("share")) + SLACK
        whole = shares.join(self.weights, ["query_id", "phrase"]).groupBy("query_id", "needed", "block").agg(bound.alias("bound"), F.max("least").alias("least"), F.count("*").alias("held"))
        return whole.where("held = needed").select("query_id", "block", "bound", "least")

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """query_id, id, score, rounded of the rows in the blocks that hold all words."""
        named = [r.block for r in blocks.select("block").distinct().limit(NAMED + 1).collect()]
        near = self.tables.postings.where(F.col("block").isin(named)) if len(named) <= NAMED else self.tables.postings
        own = self._standing(near).join(blocks, ["query_id", "block"])
        f = own.groupBy("query_id", "needed", "phrase", "id").agg(F.sum("weight").alias("f"), F.first("length").alias("length"))
        part = F.col("idf") * saturation(F.col("f"), F.col("length"), F.col("mean"))
        out = f.join(self.weights, ["query_id", "phrase"]).groupBy("query_id", "needed", "id").agg((-F.sum(part)).alias("score"), F.count("*").alias("held")).where("held = needed")
        out = out if self.rows is None else out.join(self.rows.select("id"), "id", "left_semi")
        return out.select("query_id", "id", "score", F.round("score", 9).alias("rounded"))


def search_top(tables: Blocks, books: DataFrame, query: str, category: str = "", limit: int = 30, offset: int = 0) -> DataFrame:
    """The page of ``search`` for a query with searchable words."""
    limit, offset = clamp(limit), max(0, offset)
    wanted = books.where(F.col("category") == category) if category else books
    with store.swept(books.sparkSession):
        found = Search(tables, {"q": query}, limit + offset, wanted if category else None)
        page = found.top().where(F.col("rank") > offset)
        rows = page.collect()  # a page at most
    page = F.broadcast(books.sparkSession.createDataFrame(rows, page.schema))
    return page.join(wanted.where(F.col("id").isin([r.id for r in rows])).select(*SEARCH_COLUMNS), "id").select(*SEARCH_COLUMNS, "score").orderBy("score", "id")

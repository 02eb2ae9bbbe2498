"""Operator 9: WARC derivatives.

Each response record gets a metadata record and a plain-text conversion record
that refer to it by its record id, with the response's target, date, source
headers and payload digest kept and the conversion's own digest added. Records
are rows; ``write_warc`` saves their serialized form as WARC files. The plain
text needs one Arrow UDF; all else is DataFrame functions.

Defined results: a null or empty payload still gives both records, the
conversion with an empty block; a record without an id gets one from its
target, place and payload; equal rows, and so ties, give equal records; an empty
table gives none; a long payload takes time in proportion; columns beside those
of ``responses`` are not read, so their names cannot clash. In the serialized
header a line end inside a value becomes %0D or %0A.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.dom import REST, TAG, hidden, without
from folioforge.llm.store import documents

VERSION = "WARC/1.1"
#: Pages carry no capture time, so their responses get this one.
CAPTURED = "1970-01-01T00:00:00Z"
_DROPPED = hidden("script|style|iframe", "noscript|template|svg")
#: Elements whose tags end a line (fixed list).
_BREAKS = "address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
_BREAK = re.compile(rf"</?(?:{_BREAKS})(?![^\s/><\"'])" + REST, re.S | re.I)
_MARKUP = re.compile(r"<[!?][^>]*(?:>|\Z)|" + TAG + r"|</[^>]*(?:>|\Z)", re.S)
_SPACE = re.compile(r"[^\S\n]+")


def plain_text(source: str | None) -> str:
    """Visible text of a payload, one line per block; time is linear in its length."""
    bare = _MARKUP.sub("", _BREAK.sub("\n", without(source or "", _DROPPED, "").replace("\n", " ")))
    return "\n".join(line for line in (x.strip() for x in _SPACE.sub(" ", html.unescape(bare)).split("\n")) if line)


def _plain_texts(source: pd.Series) -> pd.Series:
    return source.map(plain_text)


def _id(*parts: Column) -> Column:
    """A name-based UUID URN from the parts' hash."""
    h = F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-a"), piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def one_line(c: Column) -> Column:
    """A header's value: line ends as a URL writes them, other control characters as spaces."""
    return F.regexp_replace(F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), r"[\x00-\x1F\x7F]", " ")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Response records of a page table: key, record_id, target_uri, date, headers, payload, payload_digest."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(key).alias("key"),
        _id(F.lit("response"), F.col(key), F.col(url), body).alias("record_id"),
        F.coalesce(F.col(url), F.lit("")).alias("target_uri"),
        F.lit(CAPTURED).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n")).alias("headers"),
        body.alias("payload"),
        _digest(body).alias("payload_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two rows per response: key, record_type, record_id, refers_to, target_uri, date, content_type, block,
    block_digest, source_digest, record (the serialized record without its closing line ends)."""
    text = source.select("key", "record_id", "target_uri", "date", "headers", "payload", "payload_digest", F.pandas_udf(_plain_texts, T.StringType())("payload").alias("plain"))
    header = lambda name: F.regexp_extract("headers", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    fields = F.concat(
        F.lit("source-content-type: "), header("Content-Type"), F.lit("\r\nsource-status: "), F.regexp_extract("headers", r"^HTTP/\S+ (\d+)", 1),
        F.lit("\r\nsource-length: "), F.octet_length("payload"), F.lit("\r\ntext-length: "), F.octet_length("plain"),
        F.lit("\r\ntitle: "), F.trim(F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")),
        F.lit("\r\nconversion-id: "), _id(F.lit("conversion"), F.col("record_id")), F.lit("\r\n\r\n"), F.col("headers"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")),
    )
    made = text.select("key", "target_uri", "date", F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("source_digest"), F.explode(kinds).alias("k")).select("*", "k.*").drop("k")
    made = made.select("*", _id(F.col("record_type"), F.col("refers_to")).alias("record_id"), _digest(F.col("block")).alias("block_digest"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), one_line(c), F.lit("\r\n"))
    record = F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Refers-To-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    return made.select("key", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block", "block_digest", "source_digest", record.alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Save the serialized records as WARC files, one per partition."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that ``write_warc`` saved: headers map and block, split at the record marks by Spark's reader."""
    raw = spark.read.option("lineSep", f"\r\n\r\n{VERSION}\r\n").text(path)
    text = F.regexp_replace(F.col("value"), rf"^{re.escape(VERSION)}\r\n", "")
    cut = F.locate("\r\n\r\n", text)
    named = F.transform(F.split(F.substring(text, F.lit(1), cut - 1), "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), x.alias("v")))
    valued = F.transform(named, lambda x: F.struct(x["k"].alias("k"), F.substring(x["v"], F.char_length(x["k"]) + 3, F.char_length(x["v"])).alias("v")))
    # of a field that is given more than once the last value
    keys = F.array_distinct(F.transform(valued, lambda x: x["k"]))
    headers = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(valued, lambda x: x["k"] == k), -1)["v"]))
    return raw.select(headers.alias("headers"), F.regexp_replace(F.substring(text, cut + 4, F.char_length(text)), r"\r\n\r\n$", "").alias("block"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(documents(spark, sf_dir, "pages")))
    return made.select(F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block", "block_digest", "source_digest")

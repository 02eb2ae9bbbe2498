"""Folding, tokens and cleaning. Column functions are plain plans but NFKC, accents and expansion, which need Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters and ranges that folding removes or turns into spaces.
QUOTES = "\u05f3\u05f4'\"\u2018\u2019\u201c\u201d`\u00b4"
MARKS = r"[\u0591-\u05c7]"
SEPARATORS = r"[\u05be\-\u2010-\u2015_/\\|,.;:()\[\]{}<>]+"
CLEANED = " \t\n\r\u200e\u200f:\u00b7|"
DASHES = "-\u2013\u2014"
HEBREW = r"[\u05d0-\u05ea]"
PREFIXES = "\u05d4\u05d5"


#: White space as Java's (?U)\\s has it.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Such runs but a single plain space.
_WIDE = f" {SPACES}|{SPACES.replace(' ', '', 1)[:-1]}{SPACES[:-1]}*"
#: Texts, and bytes of them, that a UDF holds as Python strings at a time, beside its Arrow batch (a longer text by itself).
_HELD, _HELD_BYTES = 256, 1 << 20


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > lo and (i - lo == _HELD or held + n > _HELD_BYTES):
            yield texts.slice(lo, i - lo).to_pylist()
            lo, held = i, 0
        held += n
    if len(texts) > lo:
        yield texts.slice(lo).to_pylist()


def _mapped(f: Callable[[str], str], texts: pa.Array) -> Iterator[pa.Array]:
    for some in _pieces(texts):
        yield pa.array([None if x is None else f(x) for x in some], pa.string())


def _each(f: Callable[[str], str], c: Column) -> Column:
    """``f`` of each text, null where it is null. Several in a row share a Python worker."""

    def work(texts: pa.Array) -> pa.Array:
        parts = list(_mapped(f, texts))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(work, T.StringType())(c)


def _flowing(f: Callable[[str], str]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _mapped(f, texts)

    return work


def _each_alone(f: Callable[[str], str], c: Column) -> Column:
    """As ``_each`` in a Python worker of its own, which returns results as they are made and holds none beside the batch that came in."""
    return F.arrow_udf(_flowing(f), T.StringType())(c)


@cache
def _nonspacing(low: int, high: int) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(i)) for i in range(low, high) if unicodedata.category(chr(i)) == "Mn") + "]+")


def bare(text: str) -> str:
    """Base letters without their diacritics; letters such as sharp s stay."""
    if text.isascii():
        return text
    # a set with characters beyond 0xffff is tried range by range at every place, one without them is a table
    text = _nonspacing(0, 0x10000).sub("", unicodedata.normalize("NFD", text))
    return re.sub("[\U00010000-\U0010ffff]+", lambda m: _nonspacing(0x10000, 0x110000).sub("", m[0]), text)


def folded(text: str | None) -> str:
    """``normalize`` of one string."""
    text = re.sub(MARKS, "", unicodedata.normalize("NFKC", text or ""))
    text = re.sub(SEPARATORS, " ", re.sub(f"[{QUOTES}]", "", text))
    return re.sub(_WIDE, " ", text).strip(" ").lower()


def expanded_tokens(text: str | None) -> tuple[list[str], list[str]]:
    """The tokens of one string, and the stripped forms that are not among them."""
    tokens = [t for t in folded(text).split(" ") if t]
    stripped = dict.fromkeys(t[1:] for t in tokens if len(t) >= 4 and t[0] in PREFIXES)
    if not stripped:
        return tokens, []
    have = set(tokens)
    return tokens, [t for t in stripped if t not in have]


def index_terms(token: str) -> list[str]:
    """``index_tokens`` of one token."""
    text = bare(token).lower()
    if text.isascii() and text.isalnum():
        return [text]
    return "".join(c if (kind := unicodedata.category(c))[0] in "LN" or kind == "Co" else " " for c in text).split()


def nfkc(c: Column) -> Column:
    """Only texts with other than ASCII characters go to Python, as NFKC leaves the rest as they are."""
    wide = F.when(F.octet_length(c) > F.char_length(c), c)
    return F.coalesce(_each_alone(lambda x: unicodedata.normalize("NFKC", x), wide), c)


def unaccent(c: Column) -> Column:
    """Base letters without their diacritics; letters such as sharp s stay."""
    return _each(bare, c)


def fold(c: Column) -> Column:
    """``normalize`` after NFKC: marks, quotes, separators, white space, case, in this order."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, "")
    c = F.translate(c, QUOTES, "")
    c = F.regexp_replace(c, SEPARATORS, " ")
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def normalize(c: Column) -> Column:
    """The searchable form of a text; null counts as empty."""
    return fold(nfkc(F.coalesce(c, F.lit(""))))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def strip_prefix(w: Column) -> Column:
    """A word of four or more letters without one leading article or conjunction."""
    return F.when((F.char_length(w) >= 4) & w.rlike(f"^[{PREFIXES}]"), F.substring(w, 2, 1 << 20)).otherwise(w)


def expand_tokens(tokens: Column) -> Column:
    """The tokens, then each stripped form that is not among them yet."""
    return F.concat(tokens, F.array_except(F.transform(tokens, strip_prefix), tokens))


def expand(c: Column) -> Column:
    """The tokens of a text, then each stripped form that is not among them yet; null counts as empty."""
    return _each(lambda x: " ".join([w for part in expanded_tokens(x) for w in part]), F.coalesce(c, F.lit("")))


def index_tokens(c: Column) -> Column:
    """What the full-text index makes of an expanded text: runs of letters and digits, lower-case, no diacritics."""
    return F.filter(F.split(F.lower(unaccent(c)), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def has_script(c: Column, script: str = HEBREW) -> Column:
    """Whether the text holds a character of the script, Hebrew letters by default."""
    return c.rlike(script)


def squeezed(c: Column) -> Column:
    """White space collapsed to single spaces, null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")


def clean(c: Column) -> Column:
    """White space collapsed, ends stripped of spaces, direction marks, colons, dots and bars, then leading dashes."""
    ends = "[" + re.escape(CLEANED) + "]+"
    c = F.regexp_replace(squeezed(c), f"^{ends}|{ends}$", "")
    return F.regexp_replace(c, f"^[{DASHES} ]+", "")


def split_detail(c: Column, marker: str) -> Column:
    """struct(title, author) of a title string that holds the marker, else null; split at the first double hyphen."""
    rest = F.trim(F.regexp_extract(c, f"(?is){marker}(.*)", 1))
    parts = F.split(rest, "--", 2)
    return F.when(c.rlike(f"(?is){marker}"), F.struct(clean(F.get(parts, 0)).alias("title"), clean(F.get(parts, 1)).alias("author")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def client_fold(c: Column) -> Column:
    """The browser side's lighter fold: marks and quotes go, case folds."""
    return F.lower(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, ""), QUOTES[:-1], ""))


def retry_after(c: Column) -> Column:
    """Seconds to wait: the header's digits, else 30."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\d+$"), c.try_cast("double")).otherwise(30.0)


def retry_delay(status: Column, attempt: Column) -> Column:
    return F.when(status == 403, 2.0 * (attempt + 1)).otherwise(0.5 * F.pow(F.lit(2.0), attempt))


def card_line(*columns: Column) -> Column:
    """Non-empty values joined by a middle dot."""
    return F.concat_ws(" \u00b7 ", *[F.nullif(c, F.lit("")) for c in columns])


def normalize_text(text: str | None) -> str:
    """``normalize`` of one string, for query compilation on the driver."""
    text = re.sub(MARKS, "", unicodedata.normalize("NFKC", text or ""))
    text = re.sub(SEPARATORS, " ", text.translate({ord(q): None for q in QUOTES}))
    return re.sub(r"\s+", " ", text).strip().lower()

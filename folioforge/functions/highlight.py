"""Marks query tokens in displayed text, in Column functions.

A token becomes a pattern that allows the marks and quotes which folding removes
between its letters. Its matches and the text between them give spans by running
sums; the spans of all tokens are merged where they touch, and the text is put
together from escaped stretches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.blocks import before, let, stretches
from folioforge.functions.text import MARKS, QUOTES, escape_html

_SPAN = "array<struct<start:int,end:int>>"
_SKIPPED = f"(?:{MARKS}|[{re.escape(QUOTES[:-1])}])*"


def query_tokens(query: str) -> list[str]:
    """The folded words of a query: no marks, no quotes, lower case."""
    return re.sub(f"{MARKS}|[{re.escape(QUOTES[:-1])}]", "", query).lower().split()


def token_pattern(token: str) -> str:
    letters = [re.sub(r"([^\w\s])", r"\\\1", c) for c in token]
    return "(?iu)" + _SKIPPED.join(letters)


def _spans(text: Column, pattern: str) -> Column:
    """Where the pattern matches, leftmost first, without overlaps."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    between = F.slice(F.transform(F.split(text, pattern, -1), F.char_length), F.lit(1), F.size(found))
    starts = lambda n: F.zip_with(before(F.zip_with(n, between, lambda x, y: x + y), lambda a, b: a + b), between, lambda a, b: a + b)
    placed = let(found, lambda n: F.zip_with(starts(n), n, lambda s, x: F.struct(s.alias("start"), (s + x).alias("end"))))
    return F.when(F.size(found) > 0, placed).otherwise(F.array().cast(_SPAN))


def _merged(spans: Column) -> Column:
    """Sorted spans, those that overlap or touch as one: a span that begins beyond all before it begins a new one, and
    the furthest end before it ends the last."""
    bound = lambda s: before(F.transform(s, lambda x: x["end"]), F.greatest)

    def join(s: Column) -> Column:
        marked = F.zip_with(s, bound(s), lambda x, end: F.struct(x["start"].alias("start"), end.alias("before")))
        first = F.filter(marked, lambda x, i: (i == 0) | (x["start"] > x["before"]))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return let(first, lambda f: F.transform(f, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], last).alias("end"))))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), join)).otherwise(spans)


def highlight(c: Column, query: str) -> Column:
    """Escaped text with every stretch that a token matches in ``mark``; a null text counts as empty."""
    text = F.coalesce(c, F.lit(""))
    tokens = query_tokens(query)
    if not tokens:
        return escape_html(text)
    spans = _merged(F.concat(*[_spans(text, token_pattern(t)) for t in tokens]))

    def stitched(s: Column) -> Column:
        cut = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
        outside = lambda i: F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)
        parts = F.concat(F.flatten(F.transform(s, lambda x, i: F.array(cut(outside(i), x["start"]), cut(x["start"], x["end"])))), F.array(cut(outside(F.size(s)), F.char_length(text))))
        marked = lambda t, i: F.when(i % 2 == 1, F.concat(F.lit("<mark>"), escape_html(t), F.lit("</mark>"))).otherwise(escape_html(t))
        return F.array_join(F.transform(let(parts, lambda p: stretches(text, p)), marked), "")

    return let(spans, stitched)

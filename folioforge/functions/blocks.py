"""Running values over arrays and stretches of texts, in time linear in both.

An array that grows by an element is copied each time, and a substring counts
characters from the start, so both are only used inside blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are added up at a time; stretches that share a part of the text, by level.
BLOCK = 256
LEVELS = (4096, 64)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_blocks(xs: Column, size: int, then: Callable[[Column], Column]) -> Column:
    """``then`` of each run of ``size`` elements; ``xs`` is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: let(F.slice(xs, b * size + 1, size), then))


def before(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers ``xs`` what ``add`` (associative, 0 neutral) makes of those before it; ``xs`` is not empty."""
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    grow = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def joined(parts: Column) -> Column:
        first = F.aggregate(parts, blank, lambda s, p: grow(s, p["at"]), lambda s: s["out"])
        return F.flatten(F.zip_with(parts, first, lambda p, start: F.transform(p["out"], lambda x: add(start, x))))

    return let(in_blocks(xs, BLOCK, lambda own: F.aggregate(own, blank, grow)), joined)


def stretches(text: Column, spans: Column) -> Column:
    """The texts of spans (structs of int ``start`` and ``end``, code points, ends exclusive) that follow each other; there is one at least."""
    return _stretches(text, F.lit(0), spans, LEVELS)


def _stretches(text: Column, low: Column, own: Column, levels: tuple[int, ...]) -> Column:
    """``text`` begins at ``low``."""
    if not levels:
        return F.transform(own, lambda x: F.substring(text, x["start"] - low + 1, x["end"] - x["start"]))

    def block(some: Column) -> Column:
        first = F.get(some, F.lit(0))["start"]
        part = F.substring(text, first - low + 1, F.get(some, F.size(some) - 1)["end"] - first)
        return let(part, lambda t: _stretches(t, first, some, levels[1:]))

    return F.flatten(in_blocks(own, levels[0], block))

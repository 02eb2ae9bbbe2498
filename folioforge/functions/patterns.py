"""Many patterns in one pass: the first of a list, in list order, that a text holds.

The patterns become Aho-Corasick automata, broadcast in blocks of bounded size;
a text goes through each once, whatever the number of patterns in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of patterns in one automaton, which takes about a hundred bytes for each.
BLOCK_CHARS = 2_000_000


def _blocks(patterns: list[str]) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for i, p in enumerate(patterns):
        if held and size + len(p) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((i, p))
        size += len(p)
    if held:
        yield held


def _automaton(block: list[tuple[int, str]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for i, p in reversed(block):  # of equal patterns the first stays
        built.add_word(p, i)
    built.make_automaton()
    return built


def first_of(df: DataFrame, text: str | Column, patterns: list[str], name: str = "place") -> DataFrame:
    """``df`` with ``name``: the place in ``patterns`` of the first one that is part of the text; null where none is
    or the text is null. An empty pattern is part of every text."""
    spark, column = df.sparkSession, F.col(text) if isinstance(text, str) else text
    always = next((i for i, p in enumerate(patterns) if not p), None)
    found = F.when(column.isNotNull(), F.lit(always).cast("int"))
    for block in _blocks(patterns):
        block = [(i, p) for i, p in block if p]
        if not block:
            continue
        found = F.least(found, _least(spark.sparkContext.broadcast(block))(column))
    return df.withColumn(name, found)


def _least(shared: Broadcast):
    def least(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = _automaton(shared.value)
        for texts in batches:
            yield pd.Series([None if t is None else min((i for _, i in built.iter(t)), default=None) for t in texts], dtype="Int32")

    return F.pandas_udf(least, "int")

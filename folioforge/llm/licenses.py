"""Operator 10: fuzzy search for short license notices.

A notice of which ``errors`` edits are allowed is split into ``errors + 1``
pieces, one of which every match holds unchanged. Texts become lower-cased
words parted by single spaces; the pieces are found there by exact search, and
around each hit the ``regex`` library's bounded-error matching verifies the
notice and gives its span, with at most one edit inside the words that name
the license, none in a name of under five letters, as other names and words are
few edits away. The base phrases are short notices as well: an
unchanged match of theirs on word bounds counts at every place it starts.

Defined results: a null or empty text has no words and no labels; score 1 means
an unchanged notice or base phrase, 0 none; equal rows give equal results; an empty table gives no rows;
kept columns stay inside a struct, so their names cannot clash; a long text takes time in proportion to
its length.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate
from folioforge.llm.bytewords import Words
from folioforge.llm.store import documents

#: Base phrases and their labels (fixed values).
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices (fixed values): label, words, edits allowed.
NOTICES = [
    ("mit", "released under the mit license", 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license", 4),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    ("mpl", "subject to the terms of the mozilla public license", 4),
    ("cc", "licensed under a creative commons attribution", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
]

#: Letters from which a name may hold an edit; shorter ones are a letter away from other words.
LEAST_NAME = 5
#: The words of a notice that name its license (fixed values): at most one edit may fall inside them.
NAMES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gnu general public",
    "gnu lesser general public license": "gnu lesser general public",
    "gnu affero general public license": "gnu affero general public",
    "subject to the terms of the mozilla public license": "mozilla public",
    "licensed under a creative commons attribution": "creative commons attribution",
}


def seeds(notice: str, errors: int) -> list[tuple[str, int]]:
    """``errors + 1`` pieces with their offsets; some piece of any match within the edits is unchanged."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Notices:
    def __init__(self, notices: list[tuple[str, str, int]], base: list[tuple[str, str]]):
        self.base = [(label, f" {phrase} ".encode()) for phrase, label in base]
        self.notices = []
        for label, words, errors in notices:
            name = NAMES.get(words, "")
            name = f" {name} " if 0 < len(name) < LEAST_NAME else name  # a word of its own
            before, _, after = words.partition(name) if name else (words, "", "")
            exact = [regex.escape(x.encode(), special_only=True) for x in (before, name, after)]
            if name.startswith(" "):  # the edits of both sides are counted together in ``find``
                pattern = b"(?b)(?:%s){e<=%d}%s(?:%s){e<=%d}" % (exact[0], errors, exact[1], exact[2], errors)
            else:
                inside = b"(?:" + exact[1] + b"){e<=1}" if name else b""
                pattern = b"(?b)(?:" + exact[0] + inside + exact[2] + b"){e<=%d}" % errors
            self.notices.append((label, words.encode(), errors, [(s.encode(), at) for s, at in seeds(words, errors)], regex.compile(pattern)))

    def find(self, text: bytes) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, the notice's length) in the text of spaced words; of overlapping matches of a
        notice the first."""
        out = []
        for label, words, errors, parts, pattern in self.notices:
            windows = set()
            for seed, offset in parts:
                at = text.find(seed)
                while at >= 0:
                    windows.add((max(0, at - offset - errors), min(len(text), at - offset + len(words) + errors)))
                    at = text.find(seed, at + 1)
            done = 0  # windows that end here hold nothing but the match before
            for lo, hi in sorted(windows):
                m = pattern.search(text, lo, hi) if hi > done else None
                if m and sum(m.fuzzy_counts) <= errors:
                    out.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(words)))
                    done = m.end() + errors
        return sorted(set(out))


_SPAN = T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("edits", T.IntegerType())])
OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def _spaced(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a chunk, each followed by a space, rows parted by a newline and a space; each word's place; row starts."""
    lengths = w.end - w.start
    opens = np.zeros(len(lengths), dtype=np.int64)
    opens[w.first[:-1][w.counts > 0]] = 2  # newline and space before a row's first word
    ends = np.cumsum(lengths + 1 + opens)
    starts = ends - lengths - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    total = int(lengths.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(starts, lengths) + inside] = w.low[np.repeat(w.start, lengths) + inside]
    out[starts[opens > 0] - 2] = 10
    return out.tobytes(), starts


def scan(docs: DataFrame, keep: list[str], text: str = "text", notices: list[tuple[str, str, int]] = NOTICES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """``row`` (the kept columns) beside ``out``: base phrases' places, labels and the fuzzy matches' word spans."""

    def make():
        known = Notices(notices, base)
        quick = re.compile(b"|".join(re.escape(s) for s in sorted({s for n in known.notices for s, _ in n[3]})))

        def work(chunk):
            w = Words(chunk.data, chunk.offsets)
            spaced, starts = _spaced(w)
            places: dict[int, list[tuple[int, str]]] = {}
            for label, phrase in known.base:
                at = spaced.find(phrase)
                while at >= 0:
                    word = int(np.searchsorted(starts, at + 1))
                    places.setdefault(int(w.row[word]), []).append((word - int(w.first[w.row[word]]), label))
                    at = spaced.find(phrase, at + 1)
            spans: dict[int, list[tuple[int, int, str, int, int]]] = {}
            for s, e, label, edits, length in _by_row(known, spaced):
                first = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
                if first + 1 < len(starts) and s >= starts[first] + (w.end[first] - w.start[first]):
                    first += 1
                last = int(np.searchsorted(starts, e)) - 1
                row = int(w.row[last])
                first = max(first, int(w.first[row]))
                spans.setdefault(row, []).append((first - int(w.first[row]), last - int(w.first[row]), label, edits, length))
            rows = range(chunk.rows)
            found = [sorted(places.get(r, ())) for r in rows]
            fuzzy = [spans.get(r, ()) for r in rows]
            return [
                w.counts,
                [len(x) for x in found],
                [x[0][0] if x else None for x in found],
                [x[-1][0] if x else None for x in found],
                [sorted({y[1] for y in x}) for x in found],
                [sorted({y[1] for y in x} | {y[2] for y in f}) for x, f in zip(found, fuzzy, strict=True)],
                [1.0 if x else max((1 - y[3] / y[4] for y in f), default=0.0) for x, f in zip(found, fuzzy, strict=True)],
                [[{"first_word": a, "last_word": b, "label": l, "edits": e} for a, b, l, e, _ in f] for f in fuzzy],
            ]

        def _by_row(known, spaced):
            if not quick.search(spaced):
                return
            lo = 0
            while lo < len(spaced):
                hi = spaced.find(b"\n", lo + 1)
                hi = len(spaced) if hi < 0 else hi
                for s, e, label, edits, length in known.find(spaced[lo:hi]):
                    yield lo + s, lo + e, label, edits, length
                lo = hi

        return work

    return annotate(docs, text, OUT, make, keep)


def _list(column: str) -> Column:
    return F.array_join(column, ",")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), ["doc_id"])
    return found.select("row.doc_id", "out.n_words", "out.n_base", "out.first_word", "out.last_word", _list("out.base_labels").alias("base_labels"), _list("out.labels").alias("labels"), "out.score")

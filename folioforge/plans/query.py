"""From a search box string to the phrases that a row must match."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from folioforge.functions.text import normalize_text

# Words used of a query, rows of a page at most, and what a query's words may hold.
MAX_TOKENS = 8
MAX_LIMIT = 100
_UNSAFE = re.compile(r"[^\w\s\u0590-\u05ff]")
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Phrase:
    term: str
    prefix: bool


def compile_query(raw: str | None, prefix: bool = True) -> list[Phrase] | None:
    """At most eight phrases, all required, the last one a prefix; None where nothing is searchable.

    A token in which the index tokenizer finds no letter or digit matches
    nothing and stays as an empty term.
    """
    tokens = _UNSAFE.sub(" ", normalize_text(raw)).split()[:MAX_TOKENS]
    if not tokens:
        return None
    bare = ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in tokens]
    terms = ["".join(_TOKEN.findall(t)) for t in bare]
    return [Phrase(t, prefix and i == len(terms) - 1) for i, t in enumerate(terms)]


def clamp(limit: int, most: int = MAX_LIMIT) -> int:
    return max(1, min(limit, most))

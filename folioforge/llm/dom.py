"""Block structure of HTML pages, read leniently with one tokenizer pattern."""

from __future__ import annotations

import html
import re

#: A tag ends at ">" outside quotes, or before the next "<" or at the page's end, so that no place is read twice.
REST = r"((?:[^>\"'<]++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|(?=<)|\Z)"
TAG = r"<(/?)([a-zA-Z][^\s/><\"']*)" + REST
_TOKEN = re.compile(r"<[!?][^>]*(?:>|\Z)|" + TAG, re.S)


def hidden(raw: str, own: str, cdata: str = "", others: str = "") -> re.Pattern:
    """A pattern for ``without``: elements whose content ends at their end tag or the page's end, elements that
    skip content only if they are closed (and the head), and other tokens to step over whole."""
    return re.compile(rf"(?P<drop><!--.*?(?:-->|\Z)|{cdata}<(?P<raw>{raw})\b[^>]*(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<own>{own}|head)(?=[\s/>])[^>]*(?:>|\Z)" + (f"|{others}" if others else ""), re.S | re.I)


_HIDDEN = hidden("script|style|iframe|textarea", "noscript|template|svg|select", r"<!\[CDATA\[.*?(?:\]\]>|\Z)|", TAG)
_IN_HEAD = re.compile(
    r"\s+|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noframes)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)|<title\b[^>]*>(?:(?:(?!<title\b|<body\b|</head\b).)*?</title\s*>|[^<]*)"
    r"|</?(?:base|basefont|bgsound|link|meta|noscript|template|html)(?=[\s/>])[^>]*>|</(?!(?:head|body|html|br)\b)[^>]*>|<head(?=[\s/>])[^>]*>",
    re.S | re.I,
)
_HEAD_END = re.compile(r"</head\s*>", re.I)


def without(source: str, mark: re.Pattern, put: str) -> str:
    """The page with ``put`` for each part that holds no visible text. A head ends at its end tag or before the
    first thing that cannot stand in it; an element of ``own`` without an end tag loses only its own tag, later."""
    parts, closed, heads = [], {}, []
    waiting: dict[str, list[int]] = {}
    for m in mark.finditer(source):
        if m["drop"] is not None:
            parts.append(m.span())
        elif m["own"]:
            name = m["own"].lower()
            if m["end"]:
                if waiting.get(name):
                    closed[waiting[name].pop()] = m.end()
            elif name == "head":
                heads.append(m.span())
            elif name != "svg" or not m[0].endswith("/>"):
                waiting.setdefault(name, []).append(m.start())
    done = 0
    for start, at in heads:
        if start < done:
            continue
        while True:
            if at in closed:
                at = closed[at]
            elif m := _IN_HEAD.match(source, at):
                at = m.end()
            else:
                break
        m = _HEAD_END.match(source, at)
        done = m.end() if m else at
        parts.append((start, done))
    kept, at = [], 0
    for start, end in sorted([*parts, *closed.items()]):
        if start >= at:
            kept += [source[at:start], put]
        at = max(at, end)
    return "".join([*kept, source[at:]])


_SPACE = re.compile(r"\s+")
#: Elements that lay text out as blocks of its own (fixed list); all others are inline.
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset(["hr"])
#: Elements that a start tag of the same kind, or for p of any block, ends.
_SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Page:
    """Nodes in page order: tag, attrs, parent; runs: (node, text); link_chars per node."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parent, self.links = ["#root"], [""], [-1], [0]
        self.runs: list[tuple[int, str]] = []
        node, held, in_link = 0, [], False

        def flush() -> None:
            if held:
                text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
                held.clear()
                if text:
                    self.runs.append((node, text))

        at = 0
        source = without(source, _HIDDEN, "<!>")
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                held.append(piece)
                if in_link:
                    self.links[node] += len(piece)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if tag == "a":
                in_link = not m[1]
            if tag not in BLOCKS:
                if tag == "br":
                    held.append(" ")
                continue
            flush()
            if m[1]:
                up = node
                while up > 0 and self.tags[up] != tag:
                    up = self.parent[up]
                if up > 0:
                    node = self.parent[up]
                continue
            ends = _SELF_ENDING.get(tag, ())
            while node > 0 and (self.tags[node] == "p" or self.tags[node] in ends):
                node = self.parent[node]
            self.tags.append(tag)
            self.attrs.append(m[3])
            self.parent.append(node)
            self.links.append(0)
            if tag not in _VOID:
                node = len(self.tags) - 1
        if at < len(source):
            held.append(source[at:])
        flush()

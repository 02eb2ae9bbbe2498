"""Operator 5: main text of HTML pages by gradient-boosted trees over DOM nodes.

Each block element is a node with features of its subtree (text, tags, links,
densities), its attributes' tokens (hashed, its own and those it inherits), its
depth and its siblings. Two boosted ensembles give the probability that a node
is content and that its subtree holds content; a decoding from the root down
then picks the likeliest labelling in which content is not inside boilerplate: a
node is outer (may hold both), content (may hold boilerplate), or boilerplate
(all below it is).

The trees are trained at the start, on ``TRAIN_PAGES`` pages that ``template``
writes with known labels. Defined results: a null or empty page has the empty
text; a page without block elements is all main text; equal rows give equal
results; an empty table gives no rows; kept columns stay inside a struct, so
their names cannot clash; nothing is cut short, and reading takes time and
memory in proportion to a page, also where its tags or quotes do not close.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate
from folioforge.llm.dom import Page
from folioforge.llm.store import documents

TRAIN_PAGES = 1500
TREES, DEPTH, RATE = 30, 4, 0.3
#: Classes that attribute tokens are hashed to; each has a weight, its log-odds of content in the training pages.
BUCKETS = 1 << 14
#: Attributes whose words describe an element, and how they are parted (camel case too).
_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BOILER = {"nav": 1, "footer": 2, "header": 3, "aside": 4, "form": 5, "fieldset": 5, "button": 6, "menu": 1, "dialog": 6}
_MAIN = {"article": 1, "main": 2}
_TEXT = {"p": 1, "h1": 2, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "blockquote": 4, "pre": 4, "li": 5, "td": 6, "th": 6, "dd": 6, "dt": 6, "figcaption": 7}


@lru_cache(maxsize=4096)
def buckets(attrs: str) -> frozenset[int]:
    """Classes of the words in an element's describing attributes; a plural counts as its singular."""
    words = [w.lower().rstrip("s") for values in _NAMED.findall(attrs) for v in values for w in _PARTS.findall(v)]
    return frozenset(zlib.crc32(w.encode()) % BUCKETS for w in words if len(w) > 1)


def classes(page: Page) -> list[frozenset[int]]:
    """The attribute classes of each node."""
    return [buckets(a) if len(a) <= 1000 else buckets.__wrapped__(a) for a in page.attrs]  # long ones are not remembered


def features(page: Page, weight: np.ndarray) -> np.ndarray:
    """One row per node; the last columns are the weights of its own attribute classes, summed, and the sum, the
    least and the largest of its ancestors'."""
    n = len(page.tags)
    parent = page.parent
    chars, words, marks = [0] * n, [0] * n, [0] * n
    for node, text in page.runs:
        chars[node] += len(text)
        words[node] += text.count(" ") + 1
        marks[node] += text.count(".") + text.count(",")
    own = list(chars)
    links, nodes, texts = list(page.links), [1] * n, [int(t in _TEXT) for t in page.tags]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for x in (chars, words, marks, links, nodes, texts):
            x[p] += x[i]
    depth, boiler, main, place, children, heavier = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own_named = classes(page)
    own_weight, sums, least, most = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n):
        t, p = page.tags[i], parent[i]
        boiler[i], main[i] = _BOILER.get(t, 0), _MAIN.get(t, 0)
        own_weight[i] = float(sum(weight[k] for k in own_named[i]))
        if p >= 0:
            sums[i], least[i], most[i] = sums[p] + own_weight[p], min(least[p], own_weight[p]), max(most[p], own_weight[p])
        if p >= 0:
            depth[i], place[i] = depth[p] + 1, children[p]
            children[p] += 1
            main[i], boiler[i] = main[i] or main[p], boiler[i] or boiler[p]
    for i in range(1, n):
        heavier[parent[i]] = max(heavier[parent[i]], chars[i])
    up = np.maximum(np.array(parent), 0)
    c, w, k, m, q = (np.array(x, dtype=np.float64) for x in (chars, words, nodes, links, marks))
    cols = [
        np.log1p(c), np.log1p(w), c / (k + 1), m / np.maximum(c, 1), q / np.maximum(w, 1), c / max(1.0, c[0]),
        np.log1p(np.array(own, dtype=np.float64)), k, np.array(texts) / k, np.array(depth), np.array(children),
        np.array(place) / np.maximum(np.array(children)[up], 1), np.array(children)[up], c / np.maximum(np.array(heavier)[up], 1),
        np.array(boiler), np.array(main),
        np.array([_TEXT.get(t, 0) for t in page.tags]), np.array(main)[up], np.arange(n) / n, np.array(own_weight), np.array(sums), np.array(least), np.array(most),
    ]
    return np.stack([np.asarray(x, dtype=np.float32) for x in cols], axis=1)


class Trees:
    """Gradient-boosted trees for a yes-or-no label: log-loss, second-order leaves, splits at 32 quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                width = 2**level
                gt, ht = np.bincount(leaf, g, minlength=width)[:, None], np.bincount(leaf, h, minlength=width)[:, None]
                best = np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = leaf * 33 + binned[:, j]
                    gs, hs = (np.bincount(key, v, minlength=33 * width).reshape(width, 33).cumsum(axis=1)[:, : len(e)] for v in (g, h))
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best):
                        best[k], feature[width - 1 + k], cut[width - 1 + k] = top[k], j, e[at[k]]
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[width - 1 + leaf]] > cut[width - 1 + leaf])
            value = RATE * np.bincount(leaf, g, minlength=2**DEPTH) / (np.bincount(leaf, h, minlength=2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[at]] > cut[at])
            f += value[leaf]
        return f


def template(seed: int) -> tuple[str, set[str]]:
    """A page and the words of its main text; every word of a page is unlike all others."""
    r = random.Random(seed)
    count = iter(range(10**6))
    main: set[str] = set()

    def words(lo: int, hi: int, keep: bool) -> str:
        new = ["w%d" % next(count) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(lo, hi))]
        if keep:
            main.update(w.rstrip(",.") for w in new)
        return " ".join(new)

    def wrap(tag: str, cls: str, body: str) -> str:
        key = r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{cls}">{body}</{tag}>' if cls else f"<{tag}>{body}</{tag}>"

    # what is not main text may be as long as what is
    prose = lambda lo, hi: r.choice([f"<p>{words(lo, hi, False)}</p>", f"<p>{words(lo, hi, False)}</p>", "".join(f"<p>{words(20, 120, False)}</p>" for _ in range(r.randint(1, 4)))])
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3, False)}</a></li>' for i in range(k)) + "</ul>"
    # Attribute names that pages use (fixed values), by part of the page; some are of no meaning.
    odd = lambda: r.choice(["", "", "x%d" % r.randrange(99), "col-%d" % r.randrange(13), "row", "block", "box", "inner", "clearfix", "section"])
    called = lambda *names: (r.choice(names) + " " + odd()).strip()
    some = lambda x, p=0.5: x if r.random() < p else ""
    ad = lambda: wrap(r.choice(["div", "div", "aside", "section"]), called("ad", "ads", "advert", "advertisement", "sponsored", "promo-box", "banner", "ad-slot", "adsbygoogle", "sponsor"), r.choice([words(3, 30, False), prose(3, 40)]))
    head = wrap(*r.choice([("header", odd()), ("div", called("header", "site-header", "masthead", "top-bar", "page-header", "branding", "logo"))]), r.choice(["", f"<h1>{words(1, 3, False)}</h1>"]) + r.choice([words(2, 8, False), words(2, 8, False), prose(3, 40)]))
    nav = wrap(*r.choice([("nav", odd()), ("div", called("nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "toolbar")), ("ul", called("navigation", "nav-links", "menu", "pagination"))]), links(r.randint(3, 9)))
    side = wrap(*r.choice([("aside", odd()), ("div", called("sidebar", "related", "side-bar", "secondary", "recommended", "most-read", "trending")), ("aside", called("widget", "related-posts"))]), some(f"<h3>{words(1, 4, False)}</h3>", 0.8) + r.choice([links(r.randint(3, 8)), prose(5, 60)]))
    foot = wrap(*r.choice([("footer", odd()), ("div", called("footer", "copyright", "site-footer", "bottom", "legal", "social", "share"))]), r.choice(["&copy; ", ""]) + r.choice([words(3, 20, False), prose(3, 60)]))
    notice = wrap(r.choice(["div", "section", "dialog"]), called("cookie-notice", "notice", "consent", "popup", "modal", "cookie-banner", "gdpr", "alert"), prose(5, 50) + r.choice(["", f"<button>{words(1, 2, False)}</button>"]))
    form = wrap("form", r.choice(["", called("search", "newsletter", "subscribe", "login", "signup")]), f"<label>{words(1, 4, False)}</label><input><button>{words(1, 2, False)}</button>")
    remark = lambda: wrap(r.choice(["div", "li", "article"]), called("comment", "reply", "comment-body", "response"), prose(3, 60))
    comments = wrap(r.choice(["section", "div", "ol"]), called("comments", "discussion", "comment-list", "responses", "replies"), f"<h3>{words(1, 2, False)}</h3>" + "".join(remark() for _ in range(r.randint(1, 6))))
    # a heading alone, in a header of the text's own with a byline, or in an element of no name
    title = "<h1>%s</h1>" % words(2, 10, True)
    byline = wrap(r.choice(["p", "div", "span"]), called("byline", "author", "meta", "date", ""), words(1, 8, True))
    top = r.choice(["", title, title, f"<header>{title}{some(byline)}</header>", wrap("div", odd(), title + some(byline)), wrap("div", "", title)])
    body = ""
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.72:
            body += r.choice(["<p>%s</p>", "<p>%s", "<p><b>%s<br>", "<p><em>%s</em></p>"]) % words(1, r.choice([6, 30, 90]), True)
        elif kind < 0.8:
            body += f"<h2>{words(1, 8, True)}</h2>"
        elif kind < 0.86:
            body += "<ul>" + "".join(f"<li>{words(2, 15, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        elif kind < 0.9:
            body += f"<blockquote>{words(4, 40, True)}</blockquote>"
        elif kind < 0.93:
            body += "<table>" + "".join(f"<tr><td>{words(1, 4, True)}</td><td>{words(1, 4, True)}</td></tr>" for _ in range(3)) + "</table>"
        else:
            body += r.choice([ad(), form, side, notice])
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):  # elements of no name around the text
        body = wrap(r.choice(["div", "div", "section"]), odd(), body)
    body = top + body
    for _ in range(r.choice([0, 0, 0, 1])):
        body = wrap("div", odd(), body)
    if not top:
        main.difference_update(re.findall(r"w\d+", title + byline))
    elif byline not in top:
        main.difference_update(re.findall(r"w\d+", byline))
    if r.random() < 0.2:  # a text alone, in an element of its own or in none
        main.clear()
        text = "".join(r.choice(["<p>%s</p>", "<p>%s"]) % words(1, r.choice([6, 90, 300]), True) for _ in range(r.choice([1, 1, 2, 5])))
        tag = r.choice(["", "", "article", "article", "main", "div", "section"])
        return (wrap(tag, "", text) if tag else text), main
    if r.random() < 0.1:  # text and heading in elements without a name, and nothing else
        for _ in range(r.randint(1, 3)):
            body = wrap("div", "", body)
        return r.choice([body, f"<html><body>{body}</body></html>", f"<body>{body}"]), main
    if r.random() < 0.15:  # a bare page or fragment
        return (body if r.random() < 0.5 else some(head) + some(nav) + body + some(side) + some(foot)), main
    if r.random() < 0.1:  # a layout table
        cells = [f"<td>{nav}</td>", wrap("td", called("content", "main", "text", "article"), body), some(f"<td>{side}</td>")]
        return f"<html><body>{some(head)}<table><tr>{''.join(cells)}</tr></table>{some(foot)}</body></html>", main
    article = wrap(*r.choice([("article", ""), ("article", ""), ("main", ""), ("div", called("content", "post-body", "article-text", "main-content", "story-body", "entry-content", "post", "text")), ("section", called("entry", "article", "story")), ("div", odd()), ("main", called("main", "content"))]), body)
    outer = some(notice, 0.3) + some(head) + some(nav, 0.8) + some(ad(), 0.6) + some(form, 0.3)
    middle = r.choice([article + some(side), some(side) + article]) + some(ad(), 0.3) + some(comments, 0.4)
    if r.random() < 0.5:
        middle = wrap("div", r.choice(["", "wrapper", "page", "container", "layout", "site"]), middle)
    whole = f"{outer}{middle}{some(foot, 0.8)}"
    return r.choice([whole, *3 * [f"<!DOCTYPE html><html><head><title>t</title></head><body>{whole}</body></html>"]]), main


@lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES) -> tuple[np.ndarray, Trees, Trees]:
    """Weights of the attribute classes (log-odds of content in elements that have them), and the ensembles for
    "is content" and "holds content"."""
    read, content, holds, filled = [], [], [], []
    seen = np.ones((2, BUCKETS))  # nodes of each class that are not content, and that are
    for seed in range(pages):
        source, main = template(seed)
        page = Page(source)
        n = len(page.tags)
        yes, all_ = np.zeros(n), np.zeros(n)
        for node, text in page.runs:
            own = [w.rstrip(",.") in main for w in text.split()]
            yes[node] += sum(own)
            all_[node] += len(own)
        for i in range(n - 1, 0, -1):
            yes[page.parent[i]] += yes[i]
            all_[page.parent[i]] += all_[i]
        outer = np.array([t in ("#root", "html", "body") for t in page.tags])
        read.append(page)
        filled.append(all_ > 0)
        content.append((yes / np.maximum(all_, 1) > 0.5) & ~outer)
        holds.append(yes > 0)
        for i, own_classes in enumerate(classes(page)):
            if all_[i] > 0:
                seen[int(content[-1][i]), list(own_classes)] += 1
    weight = np.log(seen[1] / seen[0])
    pick = lambda ys: np.concatenate([y[f] for y, f in zip(ys, filled, strict=True)]).astype(float)
    x = np.concatenate([features(p, weight)[f] for p, f in zip(read, filled, strict=True)])
    return weight, Trees(x, pick(content)), Trees(x, pick(holds))


def score(model: tuple[np.ndarray, Trees, Trees], pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of "is content" and "holds content" of all the pages' nodes."""
    x = np.concatenate([features(p, model[0]) for p in pages])
    return model[1].log_odds(x), model[2].log_odds(x)


def decode(page: Page, content: np.ndarray, holds: np.ndarray) -> list[bool]:
    """Per node whether its own text is main text: the likeliest labels from the root down without content in boilerplate."""
    n = len(page.tags)
    yes, no = -np.logaddexp(0, -content), -np.logaddexp(0, content)
    has, hasnt = -np.logaddexp(0, -holds), -np.logaddexp(0, holds)
    outer, inner, boiler = (no + has).tolist(), (yes + has).tolist(), (no + hasnt).tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        outer[p] += max(outer[i], inner[i], boiler[i])
        inner[p] += max(inner[i], boiler[i])
        boiler[p] += boiler[i]
    state = [0] * n
    single = n == 1
    state[0] = 1 if single else 0
    for i in range(1, n):
        above = state[page.parent[i]]
        options = [(boiler[i], 2)] if above == 2 else [(inner[i], 1), (boiler[i], 2)] if above == 1 else [(inner[i], 1), (outer[i], 0), (boiler[i], 2)]
        state[i] = max(options)[1]
    return [s == 1 for s in state]


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``row`` (the kept columns) beside ``out``: text (blocks joined by line feeds), n_chars, n_nodes, n_blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(train())
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_nodes", T.LongType()), T.StructField("n_blocks", T.LongType())])

    def make():
        model = shared.value

        def work(chunk):
            read = [Page(t) for t in chunk.texts()]
            cuts = np.cumsum([0] + [len(p.tags) for p in read])
            a, b = score(model, read)
            texts, blocks = [], []
            for p, lo, hi in zip(read, cuts, cuts[1:], strict=False):
                main = decode(p, a[lo:hi], b[lo:hi])
                if all(p.tags[node] in ("#root", "html") for node, _ in p.runs):
                    main = [True] * len(p.tags)
                kept = [t for node, t in p.runs if main[node]]
                texts.append("\n".join(kept))
                blocks.append(len(kept))
            return [texts, [len(t) for t in texts], np.diff(cuts), blocks]

        return work

    return annotate(pages, html, out, make, keep)


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"), ["page_id", "url"]).select("row.page_id", "row.url", "out.text", "out.n_chars")

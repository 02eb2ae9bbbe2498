"""Operator 4: SimHash near-duplicate groups.

Each text becomes a 64-bit fingerprint of its word shingles. Fingerprints
within ``RADIUS`` bits share at least two of four 16-bit quarters, so each goes
to one bucket per pair of quarters. Buckets are compared bit-sliced: planes
hold one bit of many fingerprints side by side, carry-save counters add up the
differing planes of whole blocks of pairs at once, and a block is left as soon
as every pair in it is beyond the radius. A bucket of more than ``BUCKET`` rows
is not gathered: there, fingerprints meet at their one-bit neighbours instead,
of which none has more than 33 in a bucket. Both ways emit one link per
fingerprint to a smaller one, never all pairs, and connected components come
from alternating star contractions over those links.

Two bits find copies with hardly an edit. ``Wide`` compares in the same way at
a similarity of about 0.8 over five-word shingles: fingerprints of 256 bits,
44 of which may differ, in buckets by bands of each text's smallest shingle
hashes; what they link is checked against the texts' shingles (``near``). A bucket of more rows than ``bucket`` is dealt into chunks that each
hold the bucket's leaders too, so that a large group meets at these.

Defined results: a null, empty or blank text has fingerprint zero, which is
linked like any other; equal rows share a fingerprint and group; a row without
a doc_id keeps its fingerprint and gets the group's smallest id, or null where
no member has one; an empty table gives no rows; kept columns stay inside a
struct, so their names cannot clash. A text takes memory of about fifty times
its length in one task, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate
from folioforge.llm.bytewords import IS_TEXT, Words, gram_hashes, mix
from folioforge.llm.near import LIKE, verified
from folioforge.llm.store import cut, documents

SHINGLE = 3
RADIUS = 2
BUCKET = 1024
SEED = 42
#: Rows up to which the table of large buckets (24 bytes a row) is broadcast; a shuffled join beyond.
BROADCAST_ROWS = 500_000
#: Bits that ``_perhaps`` has for each key, and in all (16 MB).
KEY_BITS, MOST_BITS = 16, 1 << 27
_BLOCK = 8192
_STEP = 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of the four 16-bit quarters; two differing bits leave one pair equal.
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``row`` (the kept columns) beside ``out.fp``, the fingerprint as a long."""

    def make():
        def work(chunk):
            w = Words(chunk.data, chunk.offsets, IS_TEXT)
            words = [w.word(i) for i in range(len(w.start))]
            fps = np.zeros(chunk.rows, dtype=np.uint64)
            hashes, counts = [], np.zeros(chunk.rows, dtype=np.int64)
            digest = xxhash.xxh64_intdigest
            first = w.first.tolist()
            for r in np.flatnonzero(w.counts).tolist():
                own = words[first[r] : first[r + 1]]
                grams = map(b" ".join, zip(*(own[k:] for k in range(shingle)), strict=False)) if len(own) > shingle else [b" ".join(own)]
                hashes.append(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))
                counts[r] = len(hashes[-1])
            rows = np.flatnonzero(counts)
            for part, own in _pieces(rows, hashes, counts):
                fps[own] = _majority(np.concatenate(part), counts[own])
            return [fps.view(np.int64)]

        return work

    return annotate(docs, text, T.StructType([T.StructField("fp", T.LongType())]), make, keep)


def _pieces(rows: np.ndarray, hashes: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    part, own, held = [], [], 0
    for r, h in zip(rows.tolist(), hashes, strict=True):
        part.append(h)
        own.append(r)
        held += len(h)
        if held > 50_000:
            yield part, np.array(own)
            part, own, held = [], [], 0
    if own:
        yield part, np.array(own)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``counts[i]`` hashes (one at least): the bits set in over half of them.

    Unpacked bits are bytes, so adding eight of them as one number is safe for up to 255 hashes; longer runs
    are added up from such pieces.
    """
    starts = np.cumsum(counts) - counts
    pieces = (counts + 254) // 255
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8)
    total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints of one group within ``radius`` bits, those of one distance between
    positions at a time; groups are contiguous.

    ``fps`` has one 64-bit word per fingerprint, or rows of several. For each distance d between positions, the
    planes move by d against themselves, ``_STEP`` planes at a time; a block (64 pairs) leaves as soon as all its
    pairs are beyond the radius, and only blocks that stay are read on.
    """
    n = len(fps)
    if not n:
        return
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))).max())
    size, words = 64 * (fps.size // n), (n + 63) // 64
    planes = np.zeros((size, words + longest // 64 + 2), dtype=np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes.view(np.uint8)[:, : packed.shape[1]] = packed
    digits = max(1, int(radius + 1).bit_length())
    for d in range(1, longest):
        same = np.zeros(words * 64, dtype=bool)
        same[: n - d] = group[:-d] == group[d:]
        gone = ~np.packbits(same, bitorder="little").view(np.uint64)
        live = np.flatnonzero(gone != _ALL)
        gone, counters = gone[live], [np.zeros(len(live), dtype=np.uint64) for _ in range(digits)]
        q, r = divmod(d, 64)
        for at in range(0, size, _STEP):
            part = planes[at : at + _STEP]
            moved = part[:, live + q]
            if r:
                moved = moved >> np.uint64(r) | part[:, live + q + 1] << np.uint64(64 - r)
            gone = _count(counters, list(moved ^ part[:, live]), gone) | _above(counters, radius)
            stay = gone != _ALL
            if not stay.all():
                live, gone, counters = live[stay], gone[stay], [c[stay] for c in counters]
                if not len(live):
                    break
        if len(live):
            near = np.zeros(words, dtype=np.uint64)
            near[live] = ~gone
            found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            yield found, found + d


def _count(counters: list[np.ndarray], planes: list[np.ndarray], gone: np.ndarray) -> np.ndarray:
    """Adds planes to the bit-sliced counters by carry-save adders, three bits of one weight to a sum and a
    carry; returns ``gone`` with those added whose count left the counters."""
    for k in range(len(counters)):
        total, carries = counters[k], []
        for i in range(0, len(planes) - 1, 2):
            x, y = planes[i], planes[i + 1]
            half = total ^ x
            carries.append(total & x | y & half)
            total = half ^ y
        if len(planes) % 2:
            carries.append(total & planes[-1])
            total = total ^ planes[-1]
        counters[k], planes = total, carries
    for carry in planes:
        gone = gone | carry
    return gone


def _above(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the bit-sliced count is over ``limit``."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if limit >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def _smallest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(radius: int, keys: int, words: int = 1):
    """For rows sorted by ``keys`` columns, then node and fingerprint words (one word: it is the node itself):
    links (a, b) that connect what is within the radius in a bucket, one per node to a smaller position's."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: np.ndarray) -> pa.RecordBatch:
        fresh = np.concatenate([[True], (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)])
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        rows, group = rows[:, many], group[many]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        ends = np.append(starts[1:], len(group)) if len(group) else starts
        order = np.argsort(ends - starts, kind="stable")  # blocks of like group sizes
        at = np.concatenate([np.arange(starts[k], ends[k]) for k in order]) if len(order) else order
        rows, group = rows[:, at], group[at]
        node, fps = rows[keys], np.ascontiguousarray(rows[-words:].T).view(np.uint64)
        lo = 0
        while lo < len(group):
            hi = min(lo + _BLOCK, len(group))
            while hi < len(group) and group[hi] == group[hi - 1]:
                hi += 1
            low = np.arange(hi - lo)
            for left, right in close_pairs(fps[lo:hi], group[lo:hi], radius):  # a group's pairs are never held together
                left, right = low[left], low[right]
                apart = left != right
                if apart.any():
                    low = _smallest(hi - lo, left[apart], right[apart])[low]
            moved = np.flatnonzero(low != np.arange(hi - lo))
            a.append(node[lo:hi][moved])
            b.append(node[lo:hi][low[moved]])
            lo = hi
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows >= 8 * _BLOCK:
                all_ = np.concatenate(held, axis=1)
                last = np.flatnonzero((all_[:keys] != all_[:keys, -1:]).any(axis=0))
                cut_at = int(last[-1]) + 1 if len(last) else 0
                if cut_at:
                    yield links(all_[:, :cut_at])
                held, rows = [all_[:, cut_at:]], all_.shape[1] - cut_at
        if rows:
            yield links(np.concatenate(held, axis=1))

    return run


def _quarters(fp: Column, pair: tuple[int, int]) -> Column:
    part = lambda k: F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(part(pair[0]), 16).bitwiseOR(part(pair[1]))


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Of distinct fingerprints (``fp``): links (a, b) whose components are those of all pairs within ``radius``."""
    if radius > 2:
        raise ValueError("buckets by pairs of quarters are complete up to two differing bits")
    fp = F.col("fp")
    keyed = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("pair"), _quarters(fp, p).alias("key")) for i, p in enumerate(_PAIRS)])).alias("k")).select("k.pair", "k.key", "fp")
    large = cut(keyed.groupBy("pair", "key").count().where(F.col("count") > bucket).select("pair", "key"))
    if large.isEmpty():
        small, wide = keyed, None
    else:
        marked = keyed.join(large.withColumn("large", F.lit(True)), ["pair", "key"], "left")
        small, wide = marked.where("large IS NULL").select("pair", "key", "fp"), marked.where("large")
    found = small.repartition("pair", "key").sortWithinPartitions("pair", "key", "fp").mapInArrow(_compare(radius, 2), "a long, b long")
    if wide is None:
        return found
    free = [[q for q in range(4) if q not in p] for p in _PAIRS]
    one = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    bits = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[one.getItem(16 * q + b) for q in f for b in range(16)]) for f in free]), F.col("pair").cast("int") + 1)
    near = wide.select("pair", "key", "fp", F.explode(bits).alias("flip")).select("pair", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
    if radius == 2:
        low = near.groupBy("pair", "key", "meet").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    else:  # who meets at a fingerprint itself is at most one bit from it
        low = wide.select("pair", "key", F.col("fp").alias("meet"), F.col("fp").alias("low")).where(F.lit(radius == 1))
    star = near.join(low, ["pair", "key", "meet"]).where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return found.unionByName(star)


@dataclass(frozen=True)
class Wide:
    """Near copies by wide fingerprints.

    Fingerprints have ``words`` times 64 bits over shingles of ``shingle`` words. At a similarity of 0.8 texts
    differ in 39 of 256 bits on average (0.7: 49, 0.5: 69), with a deviation of 6, so ``radius`` 44 keeps most of
    what is above 0.8 and little of what is below 0.65. A text's bins hold the smallest shingle hash of each of
    ``bands`` x ``rows`` classes; two texts share a bucket where the bins of one band are equal, which at 0.8
    happens in at least one band in 99.9 % of cases.
    """

    shingle: int = 5
    words: int = 4
    radius: int = 44
    bands: int = 16
    rows: int = 4
    bucket: int = 1024
    leaders: int = 32
    like: float = LIKE

    @property
    def columns(self) -> list[str]:
        return [*[f"f{k}" for k in range(self.words)], *[f"k{k}" for k in range(self.bands)]]


def _bins(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Smallest hash of each class of each row; a class without any takes the next one's (changed by the distance)."""
    least = np.full(rows * bins, _ALL)
    h = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    np.minimum.at(least, row * bins + (h % np.uint64(bins)).astype(np.int64), h)
    least = least.reshape(rows, bins)
    out, empty = least.copy(), least == _ALL
    for step in range(1, bins):
        if not empty.any():
            break
        other = np.roll(least, -step, axis=1)
        fill = empty & (other != _ALL)
        out[fill] = other[fill] + np.uint64(step)
        empty &= ~fill
    return out


def wide_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", how: Wide = Wide()) -> DataFrame:  # noqa: B008
    """``row`` (the kept columns) beside ``out``: fp (a hash of the whole fingerprint), its words and the bands' keys."""

    def make():
        def work(chunk):
            w = Words(chunk.data, chunk.offsets, IS_TEXT)
            n = how.shingle
            grams = gram_hashes(w.hashes(), n)
            row = w.row[: len(grams)]
            inside = row == w.row[n - 1 :][: len(grams)]
            grams, row = grams[inside], row[inside]
            short = np.flatnonzero((w.counts > 0) & (w.counts < n))
            if len(short):
                own = [xxhash.xxh64_intdigest(w.gram(int(w.first[r]), int(w.counts[r])), SEED) for r in short.tolist()]
                grams, row = np.concatenate([grams, np.array(own, dtype=np.uint64)]), np.concatenate([row, short])
                order = np.argsort(row, kind="stable")
                grams, row = grams[order], row[order]
            counts = np.bincount(row, minlength=chunk.rows)
            some = np.flatnonzero(counts)
            fps = np.zeros((how.words, chunk.rows), dtype=np.uint64)
            keys = np.zeros((how.bands, chunk.rows), dtype=np.uint64)
            for lo, hi, own in _runs(counts, some):
                for k in range(how.words):
                    fps[k, own] = _majority(mix(grams[lo:hi] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), counts[own])
            if len(some):
                place = np.zeros(chunk.rows, dtype=np.int64)
                place[some] = np.arange(len(some))
                bins = _bins(grams, place[row], len(some), how.bands * how.rows).reshape(len(some), how.bands, how.rows)
                for b in range(how.bands):
                    key = np.zeros(len(some), dtype=np.uint64)
                    for r in range(how.rows):
                        key = mix(key + bins[:, b, r])
                    keys[b, some] = key
            fp = np.zeros(chunk.rows, dtype=np.uint64)
            for word in fps:
                fp = mix(fp + word)
            return [x.view(np.int64) for x in (fp, *fps, *keys)]

        return work

    out = T.StructType([T.StructField(c, T.LongType()) for c in ("fp", *how.columns)])
    return annotate(docs, text, out, make, keep)


def _runs(counts: np.ndarray, some: np.ndarray, most: int = 50_000) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices of the shingles of consecutive rows, of about ``most`` shingles, with these rows."""
    ends = np.cumsum(counts[some])
    lo = 0
    while lo < len(some):
        start = int(ends[lo] - counts[some[lo]])
        hi = max(lo + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield start, int(ends[hi - 1]), some[lo:hi]
        lo = hi


def wide_links(classes: DataFrame, how: Wide = Wide()) -> DataFrame:  # noqa: B008
    """Of distinct fingerprints (``fp`` and ``how.columns``): links (a, b) of those within the radius that meet.

    A bucket of over ``bucket`` rows is dealt into chunks by hash, and its leaders, one of each of ``leaders``
    hash classes, are in all its chunks: rows near a leader, or near each other in one chunk of any band, are
    linked. So a group that fills a bucket is one component, without all its rows in one task. Rows of a large bucket
    that are not in its largest component then meet every row of the bucket (``_rest``), so no pair that would
    join components is left out.
    """
    own = ["fp", *[f"f{k}" for k in range(how.words)]]
    bands = F.array(*[F.struct(F.lit(b).cast("long").alias("band"), F.col(f"k{b}").alias("key")) for b in range(how.bands)])
    keyed = classes.where("fp <> 0").select(*own, F.explode(bands).alias("x")).select("x.band", "x.key", *own)
    large = cut(keyed.groupBy("band", "key").count().where(F.col("count") > how.bucket).select("band", "key", F.ceil(F.col("count") / how.bucket).alias("chunks")))
    zero = F.lit(0).cast("long").alias("chunk")
    many = large.count()
    if not many:
        dealt = keyed.select("band", "key", zero, *own)
    else:
        marked = keyed.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, ["band", "key"], "left")
        wide = marked.where("chunks IS NOT NULL")
        chunk = F.pmod(F.xxhash64("fp", "band"), F.col("chunks"))
        leaders = wide.groupBy("band", "key", "chunks", F.pmod(F.xxhash64("band", "fp"), F.lit(how.leaders)).alias("class")).agg(F.min(F.struct(*own)).alias("x"))
        spread = leaders.select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "x.*")
        dealt = marked.where("chunks IS NULL").select("band", "key", zero, *own).unionByName(wide.select("band", "key", chunk.cast("long").alias("chunk"), *own)).unionByName(spread)
    sorted_ = dealt.repartition("band", "key", "chunk").sortWithinPartitions("band", "key", "chunk", "fp")
    found = sorted_.mapInArrow(_compare(how.radius, 3, how.words), "a long, b long")
    if not many:
        return found
    found = cut(found)
    return found.unionByName(_rest(wide.select("band", "key", *own), found, how))


def _rest(wide: DataFrame, found: DataFrame, how: Wide) -> DataFrame:
    """Links that the chunks of large buckets (``wide``: band, key and the fingerprints) may have missed.

    What is linked already needs no further pair inside its component. Of each bucket the rows outside its largest
    component are compared with all of the bucket, a chunk of the ones against a chunk of the others at a time:
    each task holds two chunks, and the work follows the rows outside times the bucket.
    """
    own = [c for c in wide.columns if c not in ("band", "key")]
    roots = components(found)
    placed = cut(wide.join(roots, wide["fp"] == roots["node"], "left").select("band", "key", *own, F.coalesce("root", "fp").alias("root")))
    sizes = placed.groupBy("band", "key", "root").count()
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("count", "root")).alias("x"), F.sum("count").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    most = F.lit(4 * how.bucket)
    chunks = lambda n: F.ceil(n / most).cast("long")
    split = cut(main.select("band", "key", F.col("x.root").alias("main"), chunks(F.col("n")).alias("of_all"), chunks(F.col("n") - F.col("x.count")).alias("of_rest")))
    rows = placed.join(split, ["band", "key"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), n)
    all_ = rows.select("band", "key", *own, mine(F.col("of_all"), 2).alias("x"), "of_rest").select("band", "key", *own, "x", each(F.col("of_rest")).alias("y"))
    outside = rows.where("root <> main").select("band", "key", *own, "of_all", mine(F.col("of_rest"), 3).alias("y")).select("band", "key", *own, each(F.col("of_all")).alias("x"), "y")
    met = all_.unionByName(outside).select("band", "key", F.shiftleft("x", 32).bitwiseOR(F.col("y")).alias("chunk"), *own).distinct()
    return met.repartition("band", "key", "chunk").sortWithinPartitions("band", "key", "chunk", "fp").mapInArrow(_compare(how.radius, 3, how.words), "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node with a link.

    Alternates large and small stars (each node's larger, then smaller
    neighbours move to its smallest one), which keeps no neighbour list
    together and never raises the number of links; ends when a round changes
    nothing.
    """
    edges = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    state = _state(edges)
    while state:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(moved.select(F.col("u").alias("hi"), F.col("v").alias("lo")).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))


def _state(edges: DataFrame) -> tuple | None:
    """Number and order-free sums of the links: equal before and after a round that changes nothing."""
    n, x, y = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return (n, x, y) if n else None


def group(docs: DataFrame, keep: list[str], text: str = "text", id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``row`` (the kept columns), ``fp`` and ``component_id`` (the smallest id linked to the row, itself included)."""
    return _rooted(docs, keep, text, id, radius=radius, shingle=shingle, bucket=bucket).drop("root")


def _rooted(docs: DataFrame, keep: list[str], text: str, id: str, wide: Wide | None = None, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``group`` with ``root``, which tells components apart where their smallest ids are equal or null.

    With ``wide``, the kept columns h0 and h1 tell rows' texts apart (``text_hashes``), and links between texts are
    checked against their shingles.
    """
    hashed = ["h0", "h1"]
    held, kept = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, id, text])]), list(dict.fromkeys([*keep, id]))
    also = wide.columns if wide else []
    marked = wide_fingerprints(held, kept, text, wide) if wide else fingerprints(held, kept, text, shingle)
    marked = cut(marked.select("row", "out.fp", *[f"out.{c}" for c in also]))
    classes = cut(marked.groupBy("fp").agg(F.min(F.col("row").getField(id)).alias("rep"), *[F.min(c).alias(c) for c in also]))
    if wide:
        candidates = cut(wide_links(classes, wide))
        one = cut(marked.where("fp <> 0").groupBy("fp").agg(F.min(F.struct(*[F.col("row").getField(c).alias(c) for c in hashed])).alias("x")).select("fp", "x.*"))
        picked = components(candidates)
        near = picked.select(F.col("node").alias("fp")).unionByName(picked.select(F.col("root").alias("fp"))).distinct()
        wanted = cut(one.join(near, "fp", "left_semi"))
        named = docs.select(*[F.col(c) for c in hashed], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        texts = wanted.join(_perhaps(named, wanted).where("perhaps").drop("perhaps"), hashed).groupBy("fp").agg(F.any_value("text").alias("text"))
        found = components(verified(candidates, picked, texts, wide.shingle, wide.like))
    else:
        found = components(links(classes.select("fp"), radius, bucket))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = cut(rooted.join(lowest, "root").select("fp", "root", "component_id"))
    return marked.select("row", "fp").join(of, "fp").select("row", "fp", "root", "component_id")


def text_hashes(id: str, text: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(F.lit(i), F.col(f"`{id}`").isNull(), F.col(f"`{id}`"), F.col(f"`{text}`").isNull(), F.col(f"`{text}`")).alias(f"h{i}") for i in range(2)]


def _perhaps(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``perhaps``, false only where no key has the row's h0: so that rows meet the keys in a shuffle only
    where they may match. A bit map is broadcast, which lets more rows through as it fills; none is lost."""
    n = keys.count()
    if not n:
        return rows.withColumn("perhaps", F.lit(False))
    bits = min(MOST_BITS, max(1 << 15, 1 << (n * KEY_BITS - 1).bit_length()))
    place = F.pmod("h0", F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    maps = keys.select(F.bitmap_bucket_number(place).alias("bucket"), at.alias("at")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "bucket", "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("perhaps"))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", **how) -> DataFrame:
    """The documents' own columns, exactly one row of each group: the one of the smallest id (none comes last),
    then of the smallest fingerprint and hash of id and text. ``how`` is that of ``group``, or ``wide``.

    Rows are told apart by that hash (128 bits), not by their id. Texts meet only where id and text of a kept row
    repeat; of those rows the smallest hash of the whole row stays.
    """
    key = text_hashes(id, text)
    named = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), *key)
    rows = _rooted(named, ["h0", "h1"], "text", "id", **how).groupBy("root", "fp", "row").count()
    rows = cut(rows.select("root", "fp", "row.id", "row.h0", "row.h1", "count"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "h0", "h1")).alias("x")).select("x.h0", "x.h1")
    first = cut(first)
    dropped = cut(rows.select("h0", "h1").join(first, ["h0", "h1"], "left_anti"))
    repeated = cut(rows.where("count > 1").select("h0", "h1").join(first, ["h0", "h1"], "left_semi"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = _perhaps(docs.select(row.alias("row"), *key), dropped.unionByName(repeated))
    some = told.where("perhaps").join(dropped, ["h0", "h1"], "left_anti")
    if not repeated.isEmpty():
        again = some.join(repeated, ["h0", "h1"], "left_semi").groupBy("h0", "h1").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        some = some.join(repeated, ["h0", "h1"], "left_anti").select("row").unionByName(again.select("row"))
    return told.where("NOT perhaps").select("row").unionByName(some.select("row")).select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group(documents(spark, sf_dir), ["doc_id"])
    return grouped.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

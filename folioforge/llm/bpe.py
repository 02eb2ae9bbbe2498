"""Operator 2: BPE encoding and decoding as a bounded-lookahead transducer.

``lookahead`` derives from the merge list how many symbols beyond a token can
still change it; ``Encoder.push`` reads symbols in any pieces, keeps at most a
few times that many, and emits a token as soon as it is stable. ``Decoder``
turns ids back into bytes and emits text whenever a UTF-8 character is
complete. A text is read a slice of ``SLICE`` characters at a time, and what
each slice gives goes to the digests at once, so beside the text itself and
the ids that are asked for, a task holds a slice, a window, and the output of
the words it has met (at most ``MEMO`` of them, of at most ``SHORT`` characters).

Defined results: a null or empty text has no tokens and decodes to the empty
text; special tokens' strings in a text become their ids; very long words are
held a window at a time; equal rows give equal results; an empty table gives no
rows; kept columns stay inside a struct, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.arrowtext import annotate, list_array
from folioforge.llm.store import documents

#: Words whose output a task remembers, and their length at most.
MEMO, SHORT = 250_000, 32
#: Characters read at a time.
SLICE = 1 << 16
#: The characters of the Unicode property White_Space.
_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACES = regex.compile(f"[{''.join(map(chr, _SPACE))}]+")
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: The tokenizer file's own pre-tokenizer pattern (fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LETTERS = regex.compile(r"\p{L}+").fullmatch


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token after which it cannot change any more.

    Whether (u, v) merges depends on v being complete when its rank comes, and
    an earlier rule (x, w) can prevent that only if x ends v or is a part that
    ends v's own derivation. Following such chains of falling rank adds up the
    right sides' lengths; the longest chain bounds what has to be seen.
    """
    spine: dict[str, tuple[str, ...]] = {}
    chain: dict[str, int] = defaultdict(int)
    most = 0
    length = lambda t: len(t.removesuffix("</w>")) + t.endswith("</w>")
    for u, v in merges:
        ends = spine.get(v, (v,))
        reach = length(v) + max(chain[x] for x in ends)
        most = max(most, reach)
        chain[u] = max(chain[u], reach)
        spine.setdefault(u + v, (u + v, *ends))
    return most


class Vocabulary:
    """Ids, ranks and the lookahead of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.pairs = {self.ids[u] << 20 | self.ids[v]: i for i, (u, v) in enumerate(merges)}
        self.product = [self.ids[u + v] for u, v in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.lookahead = lookahead(merges)
        self.longest = max(map(len, self.ids))
        symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(symbols)}
        #: The token of each byte inside a word and at its end, by its symbols' count in a merged token.
        self.inner = [self.ids[c] for c in symbols]
        self.final = {i: self.ids[c + self.suffix] for i, c in zip(self.inner, symbols, strict=True)}
        self.size = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for i, t in self.tokens.items()}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, tokens: list[int]) -> list[int]:
        """The merges of one run of tokens: lowest rank first, leftmost first."""
        rank, product, none = self.pairs.get, self.product, len(self.product)
        ranks = [rank(a << 20 | b, none) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            tokens[i : i + 2] = (product[r],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] << 20 | product[r], none)
            if i < len(ranks):
                ranks[i] = rank(product[r] << 20 | tokens[i + 1], none)
        return tokens


class Encoder:
    """A word's bytes in, stable token ids out; holds at most ``window`` symbols."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = 3 * (vocabulary.lookahead + vocabulary.longest)
        self.held: list[int] = []

    def push(self, data: bytes) -> Iterator[int]:
        inner, at = self.v.inner, 0
        while len(self.held) + len(data) - at >= self.window:
            take = self.window - len(self.held)
            self.held += [inner[b] for b in data[at : at + take]]
            at += take
            yield from self._stable()
        self.held += [inner[b] for b in data[at:]]

    def _stable(self) -> Iterator[int]:
        read, last = 0, len(self.held) - self.v.lookahead
        for token in self.v.merge(list(self.held)):
            if read + self.v.size[token] > last:
                break
            read += self.v.size[token]
            yield token
        del self.held[:read]

    def finish(self) -> list[int]:
        """The end of a word: all that is held becomes stable."""
        done, self.held = self.held, []
        if done:
            done[-1] = self.v.final[done[-1]]
        return self.v.merge(done)


class Decoder:
    """Ids in, text out: a byte-to-text state machine that never holds more than one unfinished character.

    With ``symbols`` it gives what the library does for a file without a
    decoder: the token strings as they stand, joined by one space; its state
    is then whether a token came before.
    """

    def __init__(self, vocabulary: Vocabulary, symbols: bool = False):
        self.v, self.symbols, self.begun = vocabulary, symbols, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push_all(self, tokens: list[int]) -> str:
        """The text that becomes ready with these tokens."""
        if not self.symbols:
            return "".join(map(self.push, tokens))
        text = " ".join(map(self.v.tokens.__getitem__, tokens))
        text, self.begun = (" " * (self.begun and bool(tokens)) + text), self.begun or bool(tokens)
        return text

    def push(self, token: int) -> str:
        name = self.v.tokens[token]
        if name in self.v.special:
            return self.utf8.decode(b"", True) + name
        ended = bool(self.v.suffix) and name.endswith(self.v.suffix)
        body = name[: -len(self.v.suffix)] if ended else name
        return self.utf8.decode(bytes(self.v.bytes[c] for c in body), ended) + " " * ended

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


Piece = tuple[str, bytes]


def _packed(ids: list[int]) -> Piece:
    """The ids in decimal, joined by spaces, and as int32 bytes."""
    return " ".join(map(str, ids)), array("i", ids).tobytes()


class Codec:
    """Texts to ids and back: every word goes through the transducer once, and a bounded memo keeps what came out."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.encoder = Encoder(self.v)
        self.memo: dict[str, Piece] = {}
        self.pieces: dict[str, Piece] = {}

    def word(self, word: str) -> Piece:
        out = _packed([*self.encoder.push(word.encode()), *self.encoder.finish()])
        if len(word) <= SHORT:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def piece(self, piece: str) -> Piece:
        """Of a run without white space, which may hold several words."""
        lower = self._lower(piece)
        known, made = self.memo.get, self.word
        words = [known(w) or made(w) for w in ([lower] if _LETTERS(lower) else _WORDS.findall(lower))]
        out = words[0] if len(words) == 1 else (" ".join([w[0] for w in words]), b"".join([w[1] for w in words]))
        if len(piece) <= 12:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    @staticmethod
    def _lower(piece: str) -> str:
        return "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()

    def _run(self, run: str) -> Iterator[list[Piece]]:
        """Of a run without white space that is longer than a slice: its words, long ones as they become stable."""
        held: list[Piece] = []
        for m in _WORDS.finditer(self._lower(run)):
            start, end = m.span()
            if end - start <= SLICE:
                held.append(self.memo.get(m[0]) or self.word(m[0]))
                if len(held) >= SLICE:
                    yield held
                    held = []
            else:
                yield held
                held = []
                for at in range(start, end, SLICE):
                    yield [_packed(list(self.encoder.push(m.string[at : min(end, at + SLICE)].encode())))]
                yield [_packed(self.encoder.finish())]
        yield held

    def _span(self, text: str) -> Iterator[list[Piece]]:
        """Of text without special tokens, slice by slice; slices end after a space or line feed, where there is one."""
        known, made = self.pieces.get, self.piece
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                end = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE)) + 1
                if not end:
                    after = [x for x in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if x >= 0]
                    end = min(after) + 1 if after else len(text)
            part = text[at:end]
            at = end
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            split = _SPACES.split(part) if _ODD_SPACE.search(part) else part.split()
            if len(part) <= SLICE:
                yield [known(p) or made(p) for p in split]
            else:
                for run in split:
                    yield from self._run(run)

    def stream(self, text: str) -> Iterator[list[Piece]]:
        """The text's tokens as they become stable, in lists of (decimal ids, int32 bytes)."""
        special = self.v.special_at
        if special is None or not special.search(text):
            yield from self._span(text)
            return
        at = 0
        for m in special.finditer(text):
            yield from self._span(text[at : m.start()])
            yield [_packed([self.v.special[m[0]]])]
            at = m.end()
        yield from self._span(text[at:])

    def encode(self, text: str) -> list[int]:
        return [i for pieces in self.stream(text) for p in pieces for i in array("i", p[1])]

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self.v)
        return machine.push_all(list(ids)) + machine.finish()


class Digests:
    """Takes tokens as they come: their number, and the SHA-256 of the decimal ids, joined by one space, and of
    what the incremental decoder makes of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.n, self.ids, self.text, self.machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary, symbols=True)

    def add(self, pieces: list[Piece]) -> bytes:
        """The pieces' ids as int32 bytes."""
        raw = b"".join([p[1] for p in pieces])
        if raw:
            self.ids.update((" " * (self.n > 0) + " ".join([p[0] for p in pieces if p[0]])).encode())
            self.text.update(self.machine.push_all(np.frombuffer(raw, dtype=np.int32).tolist()).encode())
            self.n += len(raw) // 4
        return raw

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.machine.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


_codecs: dict[str | None, Codec] = {}


def codec(path: str | None) -> Codec:
    """One per Python worker; without a path, of the default vocabulary, which the worker looks up itself."""
    if path not in _codecs:
        _codecs[path] = Codec(path or default_vocabulary())
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


OUT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def encode(docs: DataFrame, vocabulary: str | None, keep: list[str], text: str = "text", with_ids: bool = True) -> DataFrame:
    """``row`` (the kept columns) beside ``out``: token ids (null unless ``with_ids``), their number, and the
    SHA-256 of the decimal ids, joined by one space, and of what those ids decode to in the library.

    ``vocabulary`` is a file that the executors can open, or None for the default one of their own installation.
    """

    def make():
        tool = codec(vocabulary)

        def work(chunk):
            done, raw = [], []
            for t in chunk.texts():
                sink = Digests(tool.v)
                for pieces in tool.stream(t):
                    ids = sink.add(pieces)
                    if with_ids:
                        raw.append(ids)
                done.append(sink.finish())
            counts, ids, decoded = zip(*done, strict=True)
            lists = list_array(np.frombuffer(b"".join(raw), dtype=np.int32), np.array(counts), pa.int32()) if with_ids else pa.nulls(chunk.rows, pa.list_(pa.int32()))
            return [counts, ids, decoded, lists]

        return work

    return annotate(docs, text, OUT, make, keep)


def decode(tokens: DataFrame, vocabulary: str | None, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the plain text of each row's ids: words lower-cased as encoded, a space after each (null ids: null)."""
    @F.pandas_udf(T.StringType())
    def text_of(column: pd.Series) -> pd.Series:
        tool = codec(vocabulary)
        return column.map(lambda x: None if x is None else tool.decode(x))

    return tokens.withColumn(to, text_of(ids))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(documents(spark, sf_dir), None, ["doc_id"], with_ids=False)
    return done.select("row.doc_id", "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")

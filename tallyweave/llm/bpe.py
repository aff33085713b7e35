"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of its encoding. ``PrefixTable`` stores it: a token that
ends at a prefix is that one if it may stand after the last token of what precedes it. An append only adds entries,
and an edit recomputes them from its place until they meet the old ones again.

Two neighbours may stand together if no merge crosses the seam: of the tokens that make up the right edge of the left
one and the left edge of the right one, each two that exist at the same time must not form a token that would be
merged before either becomes part of something larger.

Edge cases: null texts count as empty and have no tokens; repeated rows give repeated results; extra columns are
ignored; a table without rows gives none. Memory is bounded by the longest text and a cache of CACHE pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batches, documents

CACHE = 400_000
#: White space beside white space: only there does a match hold more than one such character.
WIDE_SPACE = re.compile(r"\s\s")
VOCABULARY = "byte_bpe_50k.tiktoken"


class Vocabulary:
    """Tokens by rank, and the two parts that the last merge of each joins."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.left, self.right = [-1] * len(self.tokens), [-1] * len(self.tokens)
        for token, rank in self.ranks.items():
            if len(token) > 1 and len(parts := self.merged(token, rank)) == 2:
                self.left[rank], self.right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
        self.longest = max(map(len, self.ranks))

    def merged(self, piece: bytes, below: int) -> list[bytes]:
        """The parts of a piece after all merges of a rank below the given one, lowest first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a file of ranks, on the driver; tasks get the result by broadcast, a few MB whatever the input."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


class Encoder:
    """Encodes pieces with a vocabulary; keeps the results of up to CACHE pieces and CACHE neighbours."""

    def __init__(self, words: Vocabulary, pattern: str):
        self.words, self.pieces, self.fits = words, regex.compile(pattern).findall, {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in words.ranks.items():
            if len(token) == 1 or words.left[rank] >= 0:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.packed, self.words_packed = _Pieces(self), _Words(self)
        self.bytes = np.frombuffer(b"".join(words.tokens), np.uint8)
        self.lengths = [len(x) for x in words.tokens]
        self.sizes = np.array(self.lengths)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def follows(self, a: int, b: int) -> bool:
        """True if b may stand after a."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        tokens, ranks, left, right = self.words.tokens, self.words.ranks, self.words.left, self.words.right
        never = len(tokens)
        a_until = b_until = never
        while True:
            made = ranks.get(tokens[a] + tokens[b], never)
            if made < a_until and made <= b_until and made < never:  # at the same rank, the merge further left comes first
                return False
            if a > b and right[a] >= 0:
                a_until, a = a, right[a]
            elif left[b] >= 0 and (b >= a or right[a] < 0):
                b_until, b = b, left[b]
            elif right[a] >= 0:
                a_until, a = a, right[a]
            else:
                return True

    def last_tokens(self, piece: bytes) -> list[int]:
        """For each prefix of a piece, the one token that can end its encoding."""
        last = [-1] * len(piece)
        fits, follows = self.fits, self.follows
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if last[end] < 0:
                if end < size:
                    last[end] = token
                elif (left := last[end - size]) >= 0 and ((known := fits.get(left << 32 | token)) or known is None and follows(left, token)):
                    last[end] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        found, i, sizes = [], len(last) - 1, self.lengths
        while i >= 0:
            found.append(token := last[i])
            i -= sizes[token]
        found.reverse()
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        Where each space stands alone between other characters, every match starts at a space or ends before one, so
        that the text falls into words that are looked up whole.
        """
        if WIDE_SPACE.search(text) or not text:
            return b"".join(map(self.packed.__getitem__, self.pieces(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.packed.__getitem__, self.pieces(first)), *map(self.words_packed.__getitem__, rest)])

    def decode(self, ids: bytes) -> bytes:
        found, out = np.frombuffer(ids, "<u4"), []
        for i in range(0, len(found), 1 << 18):
            part = found[i : i + (1 << 18)]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Pieces(dict):
    """Packed ids of single matches of the pattern."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.kept(piece, self.fresh(piece.encode()))

    def fresh(self, body: bytes) -> bytes:
        known = self.encoder.words.ranks.get(body)
        ids = [known] if known is not None else self.encoder.walk(self.encoder.last_tokens(body))
        return pack(f"<{len(ids)}I", *ids)

    def kept(self, key: str, value: bytes) -> bytes:
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class _Words(_Pieces):
    """Packed ids of a word after a space, or after a line's end that it begins with."""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one match
            return self.kept(word, self.fresh(b" " + word.encode()))
        parts = self.encoder.pieces(word if word[:1] == "\n" else " " + word)
        return self.kept(word, b"".join(map(self.encoder.packed.__getitem__, parts)))


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        start, self.piece = len(self.piece), self.piece + more
        if start:
            self.last += [-1] * len(more)
            self._fill(start, None, 0)
            return
        self.last = self.encoder.last_tokens(more)

    def replace(self, start: int, stop: int, more: bytes) -> int:
        """Puts more in the place of piece[start:stop]; returns how many entries it computed anew."""
        old, tail = self.last, len(self.piece) - stop
        self.piece = self.piece[:start] + more + self.piece[stop:]
        self.last = old[:start] + [-1] * (len(more) + tail)
        return self._fill(start, old, tail)

    def _fill(self, start: int, old: list[int] | None, tail: int) -> int:
        last, follows, n, same = self.last, self.encoder.follows, len(self.piece), 0
        base = max(0, start - self.encoder.words.longest)
        shift = len(old) - n if old is not None else 0
        at = start - 1
        for end, (token, size) in self.encoder.automaton.iter(self.piece[base:].decode("latin-1")):
            end += base
            if end > at + 1 and at >= start and old is not None:  # entry at + 1 has no match: never, as every byte is a token
                continue
            if end < start or last[end] >= 0:
                continue
            before = end - size
            if before < 0 or last[before] >= 0 and follows(last[before], token):
                last[end], at = token, end
                if old is not None and end >= n - tail:
                    same = same + 1 if old[end + shift] == token else 0
                    if same >= self.encoder.words.longest:  # all that later entries look back on is as it was
                        last[end + 1 :] = old[end + 1 + shift :]
                        return end + 1 - start
        return n - start

    def ids(self) -> list[int]:
        return self.encoder.walk(self.last)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(words: Vocabulary, key: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in this process."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS[key, pattern] = Encoder(words, pattern)
    return _ENCODERS[key, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves (array) if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, path, pattern)

        def one(doc_id: int | None, text: str | None) -> tuple:
            ids = own.ids(text or "")
            row = doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
            return (*row, np.frombuffer(ids, "<i4")) if with_ids else row

        yield from batches((one(i, t) for part in parts for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)), schema)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))

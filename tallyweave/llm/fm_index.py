"""Benchmark decontamination by one FM-index per shard of the training texts.

1. Whole texts are packed into shards of about SHARD words (a text stays whole). A shard numbers its words, sorts the
   suffixes of its word sequence by prefix doubling (each text ends in a mark of its own, so that nothing repeats beyond a
   text), and keeps the Burrows-Wheeler transform as a wavelet matrix, one bit row a level, with the suffix positions
   that are a multiple of EVERY words into their text. The index is written once; any phrases can be looked up in it.
2. Test phrases are looked up in blocks of BLOCK bytes of test texts, each block against all shards: backward search moves all
   phrases of a block at once, two ranks a word; occurrences are found by stepping back to the next kept position.
3. Spans that overlap or touch are merged for each text, over all blocks, into the spans to remove.

Words: A-Z in lower case, ASCII other than letters and digits separates, other bytes belong to words. Phrases are WINDOW
consecutive words of a test item; an item of fewer words is one phrase.

Memory: a task holds a shard (SHARD words and one text, some 60 bytes a word while it is built) and a block of phrases, the driver
a block.

Edge cases: null texts have no words; an item without a word matches nothing; equal items and rows that share an item_id
count once; an item without id is named by empty text; repeated rows, also of one doc_id, give a row each; an empty
table on either side leaves nothing to hit; extra columns are ignored by the query and kept by without_contamination().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, free_names, materialize, quoted, raw
from .resampling import PLAIN

WINDOW = 10
SHARD, SHARD_DOCS, EVERY = 1 << 20, 200_000, 32
#: Bytes of test texts that are looked up at once.
BLOCK = 4 << 20


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Bits:
    """A row of bits with ranks."""

    def __init__(self, packed: bytes, n: int):
        body = np.zeros(n // 64 + 1, np.uint64)
        body.view(np.uint8)[: len(packed)] = np.frombuffer(packed, np.uint8)
        self.body, self.n = body, n
        self.before = np.zeros(len(body) + 1, np.int64)
        np.cumsum(np.bitwise_count(body), out=self.before[1:])

    @staticmethod
    def pack(bits: np.ndarray) -> bytes:
        return np.packbits(bits, bitorder="little").tobytes()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.body[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.body[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def suffix_order(symbols: np.ndarray, marks: int) -> np.ndarray:
    """Starts of all suffixes in order. symbols: 0 to marks - 1 once each and never followed by a tie, larger ones are words."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(21)
    s = np.zeros(n + 2, np.uint64)
    s[:n] = symbols + 1
    if int(symbols.max()) + 1 < 1 << 21:  # three symbols fit in one number
        key, depth = (s[:n] << bits | s[1 : n + 1]) << bits | s[2 : n + 2], 3
    else:
        key, depth = s[:n], 1
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # rank 0: beyond the end
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        own = order[tied]
        high, low = rank[own], rank[np.minimum(own + depth, n)]
        inner = np.lexsort((low, high))
        own, high, low = own[inner], high[inner], low[inner]
        order[tied] = own
        new = np.ones(len(own), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        first = np.ones(len(own), bool)
        first[1:] = high[1:] != high[:-1]
        group = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        rank[own] = high + lead - group
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Index:
    """An FM-index over the words of some texts, each followed by a mark."""

    FIELDS = "words binary, sizes array<long>, levels array<binary>, kept binary, places binary"

    @staticmethod
    def build(word_ids: list[np.ndarray], words: Numbers) -> tuple:
        sizes = np.array([len(x) for x in word_ids], np.int64)
        texts = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(int(sizes.sum()) + texts, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = np.concatenate([np.zeros(0, np.int64), *word_ids]) + texts
        symbols[ends] = np.arange(texts)
        order = suffix_order(symbols, texts)
        plain = np.where(inside, symbols - texts + 1, 0)  # in the index all marks are 0
        start = np.repeat(ends - sizes, sizes + 1)
        place = np.arange(len(symbols)) - start
        held = place % EVERY == 0
        last = plain[order - 1]
        last[order == 0] = 0
        held_rows = held[order]
        levels, row = [], last
        for level in range(int(len(words)).bit_length() - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            levels.append(Bits.pack(bit))
            row = np.concatenate([row[~bit], row[bit]])
        listed = zstandard.ZstdCompressor(3).compress(b" ".join(words))
        return listed, sizes, levels, Bits.pack(held_rows), order[held_rows].astype("<i4" if len(symbols) < 1 << 31 else "<i8").tobytes()

    def __init__(self, words: bytes, sizes: list[int], levels: list[bytes], kept: bytes, places: bytes):
        listed = zstandard.ZstdDecompressor().decompress(words).split()
        self.number = {w: i + 1 for i, w in enumerate(listed)}
        self.sizes = np.array(sizes, np.int64)
        self.n = n = int(self.sizes.sum()) + len(self.sizes)
        self.levels = [Bits(x, n) for x in levels]
        self.zeros = [n - int(b.rank(np.array([n]))[0]) for b in self.levels]
        self.kept = Bits(kept, n)
        self.places = np.frombuffer(places, "<i4" if n < 1 << 31 else "<i8").astype(np.int64)
        # where each symbol's rows start among suffixes (their first symbol), and in the last row of the matrix
        symbol = np.arange(len(listed) + 2)
        zero = np.zeros(len(symbol), np.int64)
        self.base = self._down(symbol, zero)
        self.first = np.zeros(len(symbol) + 1, np.int64)
        np.cumsum(self._down(symbol, np.full(len(symbol), n)) - self.base, out=self.first[1:])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, bits in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(symbol >> (top - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place of the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one word earlier, for rows whose transform is no mark."""
        symbol = np.zeros(len(at), np.int64)
        down = at
        for k, bits in enumerate(self.levels):
            bit, ones = bits.get(down), bits.rank(down)
            symbol = symbol * 2 + bit
            down = np.where(bit, self.zeros[k] + ones, down - ones)
        return self.first[symbol] + down - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the suffixes that start with each phrase; phrases are rows of symbols, filled up with -1."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        low[lengths == 0] = high[lengths == 0] = 0
        for back in range(1, phrases.shape[1] + 1):
            open_ = np.flatnonzero((lengths >= back) & (low < high))
            if not len(open_):
                break
            symbol = phrases[open_, lengths[open_] - back]
            start = self.first[symbol]
            low[open_], high[open_] = start + self.rank(symbol, low[open_]), start + self.rank(symbol, high[open_])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the shard the suffix of each row starts."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            own = self.kept.get(rows)
            out[open_[own]] = self.places[self.kept.rank(rows[own])] + steps
            open_, rows = open_[~own], rows[~own]
            if len(rows):
                rows = self.back(rows)
            steps += 1
        return out


def tokens(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def fm_index(docs: DataFrame) -> DataFrame:
    """shard, doc_ids, text_keys and the fields of Index, written once to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, words, ids, doc_ids, keys, total, form = TaskContext.get().partitionId(), 0, Numbers(), [], [], [], 0, None

        def shard() -> pa.RecordBatch:
            listed, sizes, levels, kept, places = Index.build(ids, words)
            columns = [pa.array([task << 24 | seq]), pa.array([doc_ids], pa.list_(form)), pa.array([keys], pa.list_(pa.binary())), pa.array([listed], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([levels], pa.list_(pa.binary())), pa.array([kept], pa.binary()), pa.array([places], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "text_keys", "words", "sizes", "levels", "kept", "places"])

        for p in parts:
            form = p.column(0).type
            for doc_id, text, key in zip(p.column(0).to_pylist(), raw(p.column(1)), p.column(2).to_pylist(), strict=True):
                found = tokens(text)
                ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                doc_ids.append(doc_id), keys.append(key)
                total += len(found)
                if total >= SHARD or len(ids) >= SHARD_DOCS:
                    yield shard()
                    seq, words, ids, doc_ids, keys, total = seq + 1, Numbers(), [], [], [], 0
        if ids:
            yield shard()

    slim = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"))
    return materialize(slim.mapInArrow(run, f"shard long, doc_ids array<{kind}>, text_keys array<binary>, {Index.FIELDS}"))


def windows(items: list[tuple], size: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, list[list[str]]]:
    """Words, and of each distinct phrase its word numbers (filled up with -1), length and items, from (name, text)."""
    words, phrases = Numbers(), {}
    for name, text in items:
        found = tuple(words[w] for w in tokens(text))
        for i in range(max(1, len(found) - size + 1) if found else 0):
            phrases.setdefault(found[i : i + size], set()).add(name)
    table = np.full((len(phrases), size), -1, np.int64)
    lengths = np.array([len(x) for x in phrases], np.int64)
    for i, x in enumerate(phrases):
        table[i, : len(x)] = x
    return list(words), table, lengths, [sorted(x) for x in phrases.values()]


def _hits(index: DataFrame, items: list[tuple], size: int) -> DataFrame:
    """shard, row, spans and items of each text of the shards that holds phrases of a block of items."""
    shared = index.sparkSession.sparkContext.broadcast(windows(items, size))  # of at most BLOCK bytes of texts
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, lengths, names = shared.value
        for p in parts:
            for i in range(len(p)):
                own = Index(*(p.column(k)[i].as_py() for k in range(1, 6)))
                number = np.array([own.number.get(w, -1) for w in words] + [-1], np.int64)
                mine = number[table]
                known = np.flatnonzero(((mine >= 0) | (table < 0)).all(1))
                low, high = own.search(mine[known], lengths[known])
                times = high - low
                if not times.sum():
                    continue
                rows = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                phrase = np.repeat(known, times)
                at = own.locate(rows)
                starts = np.cumsum(own.sizes + 1) - own.sizes - 1
                doc = np.searchsorted(starts, at, "right") - 1
                order = np.argsort(at, kind="stable")
                at, phrase, doc = at[order], phrase[order], doc[order]
                end = np.maximum.accumulate(at + lengths[phrase])
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] > end[:-1]) | (doc[1:] != doc[:-1])
                lead = np.flatnonzero(new)
                spans = np.stack([at[lead], end[np.append(lead[1:], len(at)) - 1]], 1) - starts[doc[lead]][:, None]
                edges, span_doc = np.flatnonzero(np.diff(doc, prepend=-1)), doc[lead]
                out = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)]):
                    d = int(doc[a])
                    mine_spans = spans[np.searchsorted(span_doc, d) : np.searchsorted(span_doc, d, "right")].tolist()
                    hit = set().union(*(names[k] for k in np.unique(phrase[a:b]).tolist()))
                    out.append((p.column(0)[i].as_py(), d, [{"first": x, "end": y} for x, y in mine_spans], sorted(hit)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    columns = index.select("shard", "words", "sizes", "levels", "kept", "places")
    return columns.mapInArrow(run, "shard long, row long, spans array<struct<first: long, end: long>>, items array<string>")


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, spans (first word and end, merged, in order) and items (names as strings, in order) of each text."""
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text IS NOT NULL").distinct()
    blocks = max(1, -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        items = sorted((r["name"], r["text"].encode()) for r in tests.where(F.col("block") == block).toLocalIterator())
        found.append(_hits(index, items, size))
        if blocks > 1:
            found[-1] = materialize(found[-1])
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    per_text = hits.groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    if blocks > 1:
        per_text = per_text.select("shard", "row", "items").join(_merged(hits), ["shard", "row"])
    texts = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "sizes")).alias("row", "x")).select("shard", F.col("row").cast("long").alias("row"), "x.*")
    out = texts.join(per_text, ["shard", "row"], "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(per_text.schema[c].dataType)).alias(c)
    return out.select(F.col("doc_ids").alias("doc_id"), F.col("text_keys").alias("text_key"), F.col("sizes").alias("n_words"), none("spans"), none("items"))


def _merged(hits: DataFrame) -> DataFrame:
    """shard, row and spans of several blocks, those that overlap or touch as one."""
    rows = hits.select("shard", "row", F.explode("spans").alias("span")).select("shard", "row", "span.*")
    line = Window.partitionBy("shard", "row").orderBy("first", "end")
    until = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("first") > until).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("shard", "row", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return runs.groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the words of all spans cut out of the texts, separators left; n_chars, if there is one, is that of the new text.

    Spans follow from the text alone, so rows meet them by a digest of the text; all columns stay.
    """
    spans = search(fm_index(docs), benchmark, size).where(F.size("spans") > 0).groupBy("text_key").agg(F.any_value("spans").alias("spans"))
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), "text", key.alias("text_key")).join(spans, "text_key", "left").select("row", "text", "spans")
    new, = free_names(docs.columns, "new_text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            texts = [t if t is None or not found else _cut(t.encode(), found) for t, found in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(texts, pa.string())], ["row", new])

    found = rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType).add(new, "string"))
    own = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return found.select(*(own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _cut(text: bytes, spans: list[dict]) -> str:
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(PLAIN))]
    pieces, at = [], 0
    for x in spans:
        pieces.append(text[at : places[x["first"]][0]])
        at = places[x["end"] - 1][1]
    return b"".join([*pieces, text[at:]]).decode()


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fm_index(documents(spark, sf_dir))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

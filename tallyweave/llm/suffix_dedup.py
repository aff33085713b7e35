"""Suffix-array dedup: removes bytes covered by a string of DEPTH bytes that also starts in an earlier document.

1. Texts are packed into blocks, written once. Every window of DEPTH bytes is charged to the least hash among its
   GRAM-byte strings, its anchor; neighbouring windows with one anchor form a run. Equal windows have equal anchors at
   equal distances, so only runs with equal anchor hashes can share a window.
2. Anchor and content hashes of each block's distinct runs go to buckets of the hash. Runs of equal content are settled
   there: all but those of the least doc_id go. Runs whose anchor also has other content are left for the next step.
3. For those the bytes go to buckets of a longer string, the anchor and SIDE bytes before it (windows that hold these) or
   behind it (all others), so that a phrase of many contexts spreads out; each bucket is settled by blockwise suffix
   sorting: one group of suffixes
   (by first byte) is sorted at a time, by its first PERIOD bytes; longer ties are resolved by the ranks of
   difference-cover samples and the last PERIOD bytes. Samples of DEPTH - PERIOD + 1 bytes are ranked once a bucket.
   As bytes are laid out with anchors at multiples of PERIOD, equal windows have equal residues and need one shift
   each. Neighbours in the order that agree are equal windows, byte by byte; the least doc_id keeps its own.
4. Spans are merged for each document.

Memory is bounded by a block (BLOCK bytes and one text) and by a bucket, whose number grows with the input. A passage
that many documents share is one run for each block at most when it is sent. What is left in one bucket of step 2 is a
record of 17 bytes for each different run of one anchor in each block.

Edge cases: null texts are empty; texts below DEPTH bytes lose nothing; rows that share a doc_id do not remove each
other's bytes; a null doc_id counts as the largest; an empty table gives no rows; extra columns are ignored, or kept
as they are by without_repeats(). Kept bytes that are no whole characters at a cut are left out of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import batches, documents, free_names, materialize, mix, quoted, raw

DEPTH, GRAM = 50, 25
SIDE = (DEPTH - GRAM + 1) // 2
#: A difference cover: each residue modulo PERIOD is a difference of two elements of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
SAMPLE = DEPTH - PERIOD + 1
BLOCK, BLOCK_DOCS = 4 << 20, 50_000
CHUNK = 1 << 18
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 8 << 20, 256
LAST = (1 << 63) - 1

_SHIFT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
_BASE = 0x5851F42D4C957F2D
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, CHUNK + DEPTH)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK + DEPTH)


def _blocks(docs: DataFrame, keep: bool) -> DataFrame:
    """block, doc_ids, sizes, body (compressed texts one after another) and, if asked for, the other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] if keep else []
    slim = docs.select("doc_id", "text", F.struct(*quoted(rest), F.lit(0).alias(free_names(rest, "_")[0])).alias("rest"))
    fields = StructType().add("block", "long").add("doc_ids", ArrayType(LongType())).add("sizes", ArrayType(LongType())).add("body", "binary").add("rest", ArrayType(slim.schema["rest"].dataType))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
        ids, texts, others, size, form = [], [], [], 0, None

        def block() -> pa.RecordBatch:
            columns = [pa.array([task << 24 | seq]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))]), pa.array([others], pa.list_(form))]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "body", "rest"])

        for part in parts:
            form = part.column(2).type
            for doc_id, text, other in zip(part.column(0).to_pylist(), raw(part.column(1)), part.column(2).to_pylist(), strict=True):
                ids.append(doc_id), texts.append(text), others.append(other)
                size += len(text)
                if size >= BLOCK or len(ids) >= BLOCK_DOCS:
                    yield block()
                    seq, ids, texts, others, size = seq + 1, [], [], [], 0
        if ids:
            yield block()

    return materialize(slim.mapInArrow(run, fields))


class Block:
    """A block's text and the owner of each place."""

    def __init__(self, doc_ids: list, sizes: list, body: bytes):
        self.text = zstandard.ZstdDecompressor().decompress(body) if sum(sizes) else b""
        self.bytes = np.frombuffer(self.text, np.uint8)
        self.ids = np.array([LAST if x is None else x for x in doc_ids], np.int64)
        self.ends = np.cumsum(np.array(sizes, np.int64))

    def runs(self) -> tuple[np.ndarray, ...]:
        """first window, last window, anchor, anchor hash, content hash, document (place in ids), and hashes of the anchor
        with SIDE bytes before and behind it (of use where windows hold them) of each run."""
        found = [r for c in range(0, max(0, len(self.bytes) - DEPTH + 1), CHUNK) if (r := self._chunk(c))]
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.uint64, np.uint64))
        first, last, at, h, s, before, behind = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, last, at, h, s, np.searchsorted(self.ends, first, "right"), before, behind

    def _chunk(self, c: int) -> tuple | None:
        text = self.bytes[c : c + CHUNK + DEPTH - 1]
        n = len(text) - DEPTH + 1
        ok = np.ones(n, bool)
        for e in self.ends[np.searchsorted(self.ends, c, "right") : np.searchsorted(self.ends, c + n + DEPTH, "right")].tolist():
            ok[max(0, e - DEPTH + 1 - c) : max(0, e - c)] = False
        if not ok.any():
            return None
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_VALUES[text] * _INVERSE[: len(text)], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * _POWER[: len(text) - GRAM + 1])
        bits, span = np.uint64(19), DEPTH - GRAM + 1
        least, size = grams >> bits << bits | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        at = (least & np.uint64((1 << 19) - 1)).astype(np.int64)[:n]
        change = np.flatnonzero(np.diff(at)) + 1
        edge = np.flatnonzero(np.diff(ok)) + 1
        cuts = np.union1d(change, edge)
        first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]]) - 1
        good = ok[first]
        first, last = first[good], last[good]
        at = at[first]
        whole = (total[last + DEPTH] - total[first]) * _POWER[first]
        content = mix(whole + ((at - first) * 64 + (last - first)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        context = lambda x: mix((total[np.minimum(x + GRAM + SIDE, len(text))] - total[x]) * _POWER[x])
        # an anchor is a least hash: mixed once more, as its leading bits choose the bucket
        return first + c, last + c, at + c, mix(grams[at]), content, context(np.maximum(at - SIDE, 0)), context(at)

    def distinct(self) -> tuple:
        """Runs in order of hash, content and document; place of each group's first; and the group of each run."""
        runs = self.runs()
        first, _, _, h, s, doc, *_ = runs
        order = np.lexsort((first, self.ids[doc] if len(doc) else doc, s, h))
        runs = tuple(x[order] for x in runs)
        h, s = runs[3], runs[4]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        return runs, np.flatnonzero(new), np.cumsum(new) - 1


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of integers, all first bytes first: sorted or small numbers then compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplaned(data: bytes, size: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, size * n).reshape(size, n).T
    return out.view("<u8").ravel()


def _send(blocks: DataFrame, log_buckets: int) -> DataFrame:
    """bucket, block, n and the records (32 bits of anchor hash, 40 of content hash, doc_id) of distinct runs."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("records", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for i in range(len(part)):
                    block, ids, sizes, body = (part.column(k)[i].as_py() for k in range(4))
                    own = Block(ids, sizes, body)
                    runs, lead, _ = own.distinct()
                    h, s, doc = runs[3][lead], runs[4][lead] >> np.uint64(24), own.ids[runs[5][lead]] if len(lead) else lead
                    bucket = h >> np.uint64(64 - log_buckets)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
                        yield int(bucket[a]), block, b - a, _planes(h[a:b] >> np.uint64(32 - log_buckets), 4) + _planes(s[a:b], 5) + _planes(doc[a:b].view(np.uint64), 8)

        yield from batches(rows(), schema, 64)

    return blocks.select("block", "doc_ids", "sizes", "body").mapInArrow(run, "bucket int, block long, n long, records binary")


def settle_runs(h: np.ndarray, s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records: an earlier document has the same run; or this one must be compared byte by byte."""
    order = np.lexsort((doc, s, h))
    h, s, doc = h[order], s[order], doc[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= s[1:] != s[:-1]
    lead = np.flatnonzero(new)
    gone = doc > doc[lead][np.cumsum(new) - 1]
    heads = np.flatnonzero(new_h)
    group = np.cumsum(new_h) - 1
    several = np.add.reduceat(new.astype(np.int64), heads) > 1
    several &= np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    out_gone, out_open = np.empty(len(h), bool), np.empty(len(h), bool)
    out_gone[order], out_open[order] = gone, ~gone & several[group]
    return out_gone, out_open


def _answers(sent: DataFrame) -> DataFrame:
    """block, bucket, flags of each set of records that has any."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fields = [[], [], []]
        for n, records in zip(rows["n"], rows["records"]):
            fields[0].append(_unplaned(records, 4, n))
            fields[1].append(_unplaned(records[4 * n :], 5, n))
            fields[2].append(_unplaned(records[9 * n :], 8, n).view(np.int64))
        gone, open_ = settle_runs(*map(np.concatenate, fields))
        cuts = np.cumsum(rows["n"].to_numpy())[:-1]
        flags = [(np.packbits(a).tobytes() + np.packbits(b).tobytes()) if a.any() or b.any() else None for a, b in zip(np.split(gone, cuts), np.split(open_, cuts))]
        out = pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "flags": flags})
        return out[out["flags"].notna()]

    return sent.groupBy("bucket").applyInPandas(run, "block long, bucket int, flags binary")


def _apply(blocks: DataFrame, answers: DataFrame, log_buckets: int) -> DataFrame:
    """kind 0: spans of a block that are settled; kind 1: runs with their bytes, to be compared in their bucket."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for i in range(len(part)):
                    block, ids, sizes, body, flags = (part.column(k)[i].as_py() for k in range(5))
                    own = Block(ids, sizes, body)
                    runs, lead, group = own.distinct()
                    if not len(lead):
                        continue
                    first, last, at, h, _, doc, before, behind = runs
                    bucket = (h[lead] >> np.uint64(64 - log_buckets)).astype(np.int64)
                    gone, open_ = np.zeros(len(lead), bool), np.zeros(len(lead), bool)
                    for x in flags or []:
                        a, b = np.searchsorted(bucket, x["bucket"]), np.searchsorted(bucket, x["bucket"], "right")
                        size = -(-(b - a) // 8)
                        gone[a:b] = np.unpackbits(np.frombuffer(x["flags"], np.uint8, size), count=b - a)
                        open_[a:b] = np.unpackbits(np.frombuffer(x["flags"], np.uint8, size, size), count=b - a)
                    ids_of = own.ids[doc]
                    later = ids_of > ids_of[lead][group]
                    settled = gone[group] | later
                    spans = merged(first[settled], last[settled] + DEPTH, doc[settled])
                    yield 0, block, None, len(spans[0]), _planes(spans[0], 5) + _planes(spans[1], 5)
                    k = np.flatnonzero(open_[group] & ~later)
                    sides = (before, first, np.minimum(last, at - SIDE)), (behind, np.maximum(first, at - SIDE + 1), last)
                    for context, low, high in sides:
                        own_k = k[low[k] <= high[k]]
                        own_bucket = (context[own_k] >> np.uint64(64 - log_buckets)).astype(np.int64)
                        order = np.argsort(own_bucket, kind="stable")
                        own_k, own_bucket = own_k[order], own_bucket[order]
                        cuts = np.flatnonzero(np.diff(own_bucket, prepend=-1))
                        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own_k)]):
                            j = own_k[a:b]
                            bodies = b"".join(own.text[x:y] for x, y in zip(low[j].tolist(), (high[j] + DEPTH).tolist()))
                            yield 1, block, int(own_bucket[a]), b - a, _planes(ids_of[j].view(np.uint64), 8) + _planes(low[j], 5) + _planes(high[j] - low[j], 2) + _planes(at[j] - low[j], 2) + bodies

        yield from batches(rows(), schema, 64)

    listed = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    joined = blocks.select("block", "doc_ids", "sizes", "body").join(listed, "block", "left")
    return materialize(joined.mapInArrow(run, "kind int, block long, bucket int, n long, data binary"))


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[at]).view(">u8").ravel().astype(np.uint64)


def _ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, the first one leading, and whether each in it differs from the one before."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, new


def earlier_windows(bodies: np.ndarray, sizes: np.ndarray, shift: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(body, offset) of each window of DEPTH bytes that a body of an earlier document has too.

    bodies: all bytes, one body after another; shift: where in each body its anchor is.
    """
    slots = -(-(sizes + PERIOD) // PERIOD) * PERIOD
    place = np.cumsum(slots) - slots + (-shift) % PERIOD
    text = np.zeros(int(slots.sum()) + 64, np.uint8)
    text[np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(bodies))] = bodies
    spread = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    body, offset = spread(sizes - DEPTH + 1)
    start = place[body] + offset
    sample_body, sample_at = spread(sizes - SAMPLE + 1)
    sample = place[sample_body] + sample_at
    sample = sample[np.isin(sample % PERIOD, COVER)]
    order, new = _ranked([_words(text, sample + i) for i in (0, 8, 16, 24, SAMPLE - 8)])
    rank = np.zeros(len(text), np.int64)
    rank[sample[order]] = np.cumsum(new)
    gone = np.zeros(len(start), bool)
    by_first = np.argsort(text[start], kind="stable")
    for part in np.split(by_first, np.flatnonzero(np.diff(text[start][by_first])) + 1):  # one bucket of suffixes at a time
        s = start[part]
        head = [_words(text, s), _words(text, s + PERIOD - 8)]
        tail = [_words(text, s + DEPTH - PERIOD), _words(text, s + DEPTH - 8)]
        order, new = _ranked([*head, s % PERIOD, rank[s + _SHIFT[s % PERIOD]], *tail])
        d, lead = doc[body[part[order]]], np.flatnonzero(new)
        gone[part[order]] = d > np.minimum.reduceat(d, lead)[np.cumsum(new) - 1] if len(lead) else False
    return body[gone], offset[gone]


def _compared(runs: DataFrame) -> DataFrame:
    """block, n and spans that the comparison of bytes settles."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs, firsts, sizes, shifts, bodies, owner = [], [], [], [], [], []
        for i, (n, data) in enumerate(zip(rows["n"], rows["data"])):
            docs.append(_unplaned(data, 8, n).view(np.int64))
            firsts.append(_unplaned(data[8 * n :], 5, n).astype(np.int64))
            sizes.append(_unplaned(data[13 * n :], 2, n).astype(np.int64) + DEPTH)
            shifts.append(_unplaned(data[15 * n :], 2, n).astype(np.int64))
            bodies.append(data[17 * n :])
            owner.append(np.full(n, i))
        body, offset = earlier_windows(np.frombuffer(b"".join(bodies), np.uint8), *map(np.concatenate, (sizes, shifts, docs)))
        start, own = np.concatenate(firsts)[body] + offset, np.concatenate(owner)[body]
        out = []
        for i in np.unique(own):
            a, b, _ = merged(start[own == i], start[own == i] + DEPTH)
            out.append((rows["block"].iloc[i], len(a), _planes(a, 5) + _planes(b, 5)))
        return pd.DataFrame(out, columns=["block", "n", "data"])

    return runs.groupBy("bucket").applyInPandas(run, "block long, n long, data binary")


def merged(start: np.ndarray, end: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of a document, in order; without documents only spans that overlap become one."""
    if doc is None:
        doc = start
        joins = lambda s, e, d: s[1:] < e[:-1]
    else:
        joins = lambda s, e, d: (s[1:] <= e[:-1]) & (d[1:] == d[:-1])
    if not len(start):
        return start, end, doc
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], np.maximum.accumulate(end[order]), doc[order]  # documents follow one another
    new = np.ones(len(start), bool)
    new[1:] = ~joins(start, end, doc)
    lead = np.flatnonzero(new)
    return start[lead], end[np.append(lead[1:], len(start)) - 1], doc[lead]


def _results(blocks: DataFrame, spans: DataFrame, keep: bool) -> DataFrame:
    fields = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep:
        fields = fields.add("text", "string").add("rest", blocks.schema["rest"].dataType.elementType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                _, ids, sizes, body, rest, found = (part.column(k)[i].as_py() for k in range(6))
                own = Block(ids, sizes, body)
                ends = own.ends.tolist()
                empty = np.zeros(0, np.int64)
                start = np.concatenate([empty, *(_unplaned(x["data"], 5, x["n"]).astype(np.int64) for x in found or [])])
                end = np.concatenate([empty, *(_unplaned(x["data"][5 * x["n"] :], 5, x["n"]).astype(np.int64) for x in found or [])])
                start, end, doc = merged(start, end, np.searchsorted(own.ends, start, "right"))
                cuts = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
                out = []
                for j, (doc_id, size) in enumerate(zip(ids, sizes, strict=True)):
                    a, b, at, pieces = cuts[j], cuts[j + 1], ends[j] - size, []
                    for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
                        pieces.append(own.text[at:x])
                        at = y
                    left = b"".join([*pieces, own.text[at : ends[j]]])
                    row = doc_id, size, size - len(left), b - a, hashlib.sha256(left).hexdigest()
                    out.append((*row, left.decode(errors="ignore"), rest[j]) if keep else row)
                yield from batches(out, form(part.schema), 10_000)

    def form(given: pa.Schema) -> pa.Schema:
        own = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return pa.schema([*own, ("text", pa.string()), ("rest", given.field(4).type.value_type)] if keep else own)

    listed = spans.groupBy("block").agg(F.collect_list(F.struct("n", "data")).alias("found"))
    return blocks.select("block", "doc_ids", "sizes", "body", "rest").join(listed, "block", "left").mapInArrow(run, fields)


def remove_repeats(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep also the text that is left and the other columns."""
    blocks = _blocks(docs, keep)
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    log_buckets = max(LEAST_BUCKETS, -(-size // BUCKET)) - 1
    log_buckets = int(log_buckets).bit_length()
    marked = _apply(blocks, _answers(_send(blocks, log_buckets)), log_buckets)
    spans = marked.where("kind = 0").select("block", "n", "data").union(_compared(marked.where("kind = 1")))
    return _results(blocks, spans, keep)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of the texts; n_chars, if there is one, is that of the new text."""
    found = remove_repeats(docs, keep=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))

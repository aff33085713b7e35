"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator of that format then
walks the structure and returns the length, or rejects the hit. A validated format at offset 0 corrects the declared
type; validated formats further inside, within another medium's extent or not, are carved.

Hits are validated from the last to the first. Formats that are chains of parts (chunks, pages, boxes, segments) keep
where each part's chain ends, and formats with a mark at their end look it up in the sorted places of that mark, so
that a body full of magic numbers costs no more than a few passes over it.

Edge cases: null bytes count as empty; empty bytes have type application/octet-stream and no media; repeated rows
give repeated results; extra columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, documents, raw

ROW = 192

#: Fixed values of the public formats: magic bytes, distance of the magic from the start of the file, kind.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"), (b"\xff\xd8\xff", 0, "image/jpeg"), (b"GIF87a", 0, "image/gif"), (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"), (b"RIFF", 0, "riff"), (b"OggS", 0, "audio/ogg"), (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"PK\x03\x04", 0, "application/zip"), (b"%PDF-", 0, "application/pdf"), (b"ftyp", 4, "video/mp4"),
]
#: Marks that end a format, or stand near its end.
MARKS = (b"PK\x05\x06", b"%%EOF", b"startxref")
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, ahead, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), ahead, kind))
    for mark in MARKS:
        found.add_word(mark.decode("latin-1"), (len(mark), 0, mark))
    found.make_automaton()
    return found


class Body:
    """Bytes, where the marks lie in them, and where chains of parts end that were walked before."""

    def __init__(self, data: bytes):
        self.data, self.ends = data, {}
        self.marks: dict[bytes, list[int]] = {m: [] for m in MARKS}
        self.hits: list[tuple[int, str]] = []
        for end, (size, ahead, kind) in _automaton().iter(data.decode("latin-1")):
            at = end + 1 - size - ahead
            if isinstance(kind, bytes):
                self.marks[kind].append(at)
            elif at >= 0:
                self.hits.append((at, kind))

    def next(self, mark: bytes, at: int) -> int:
        """The first place of a mark from at on, or -1."""
        places = self.marks[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def follow(self, kind: str, at: int, step: Callable[[int], tuple[bool, int]]) -> int:
        """The end of the chain of parts from at on. step: (True, the next part's place), or (False, the end or 0)."""
        known, passed = self.ends.setdefault(kind, {}), []
        while True:
            if (end := known.get(at)) is None:
                more, place = step(at)
                passed.append(at)
                if more:
                    at = place
                    continue
                end = place
            known.update(dict.fromkeys(passed, end))
            return end

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of an archive, by what its end record says, and the nearest end."""
        out: dict[int, int] = {}
        for end in self.marks[b"PK\x05\x06"]:
            if end + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
                at = end - size - start
                if at >= 0 and self.data[at + start : at + start + 4] == b"PK\x01\x02":
                    out.setdefault(at, min(end + 22 + note, len(self.data)))
        return out


def _png(body: Body, at: int) -> int:
    b = body.data

    def step(i: int) -> tuple[bool, int]:
        if i + 12 > len(b):
            return False, 0
        n, name = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return False, 0
        return name != b"IEND", i + 12 + n

    return max(body.follow("png", at + 8, step) - at, 0) if b[at + 12 : at + 16] == b"IHDR" else 0


def _jpeg(body: Body, at: int) -> int:
    b = body.data

    def step(i: int) -> tuple[bool, int]:
        """A segment, or behind a scan's header the compressed bytes up to the next marker."""
        if i + 4 > len(b) or b[i] != 0xFF:
            return False, 0
        mark, n = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if mark in (0x00, 0xFF) or n < 2:
            return False, 0
        i += 2 + n
        if mark != 0xDA:
            return True, i
        stop = body.follow("scan", i, scan)
        return (False, stop + 2) if stop and b[stop + 1] == 0xD9 else (bool(stop), stop)

    def scan(i: int) -> tuple[bool, int]:
        i = b.find(b"\xff", i)
        if i < 0 or i + 1 >= len(b):
            return False, 0
        return (True, i + 2) if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7 else (False, i)

    return max(body.follow("jpeg", at + 2, step) - at, 0)


def _gif(body: Body, at: int) -> int:
    b = body.data
    if at + 13 > len(b):
        return 0

    def step(i: int) -> tuple[bool, int]:
        """An extension or a frame."""
        if i >= len(b):
            return False, 0
        if b[i] == 0x3B:
            return False, i + 1
        if b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)
        elif b[i] == 0x21:
            i += 2
        else:
            return False, 0
        return True, body.follow("gif blocks", i, block)

    def block(i: int) -> tuple[bool, int]:
        if i < len(b) and b[i]:
            return True, i + 1 + b[i]
        return False, i + 1

    first = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    has_frame = body.follow("gif frames", first, lambda i: (True, step(i)[1]) if b[i : i + 1] == b"!" and step(i)[0] else (False, int(b[i : i + 1] == b",")))
    return max(body.follow("gif", first, step) - at, 0) if has_frame else 0


def _bmp(body: Body, at: int) -> int:
    b = body.data
    if at + 54 > len(b):
        return 0
    size, unused, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if unused or planes != 1 or header not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not height:
        return 0
    whole = start + (width * bits + 31) // 32 * 4 * abs(height)
    return size if whole == size and at + size <= len(b) else 0


def _riff(body: Body, at: int) -> int:
    """The chunks must fill the length that the header says; chains that end alike share their places."""
    b = body.data
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b) or end < at + 20:
        return 0

    def step(i: int) -> tuple[bool, int]:
        if i == end or i + 8 > end:
            return False, i if i == end else 0
        return True, i + 8 + (-(-struct.unpack_from("<I", b, i + 4)[0] // 2) * 2)

    return end - at if body.follow(f"riff {end}", at + 12, step) == end else 0


def _ogg(body: Body, at: int) -> int:
    b = body.data

    def step(i: int) -> tuple[bool, int]:
        if b[i : i + 5] != b"OggS\0" or i + 27 > len(b):
            return False, 0
        n = b[i + 26]
        stop = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        return (False, 0) if stop > len(b) else (not b[i + 5] & 4, stop)

    return max(body.follow("ogg", at, step) - at, 0)


def _gzip(body: Body, at: int) -> int:
    b = body.data
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    unpack = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):  # in pieces, so that an expanding member is never held whole
            rest = b[i : i + (1 << 16)]
            while rest and not unpack.eof:
                unpack.decompress(rest, 1 << 20)
                rest = unpack.unconsumed_tail
            if unpack.eof:
                return min(i + (1 << 16), len(b)) - len(unpack.unused_data) - at
    except zlib.error:
        pass
    return 0


def _zip(body: Body, at: int) -> int:
    """The nearest end record whose directory lies where it says, counted from this local header."""
    return body.archives.get(at, at) - at


def _pdf(body: Body, at: int) -> int:
    stop = body.next(b"%%EOF", at)
    return stop + 5 - at if stop >= 0 and -1 < body.next(b"startxref", at) < stop else 0


def _mp4(body: Body, at: int) -> int:
    b = body.data

    def step(i: int) -> tuple[bool, int]:
        if i + 8 > len(b):
            return False, i
        n, name = struct.unpack_from(">I4s", b, i)
        return (True, i + n) if n >= 8 and i + n <= len(b) and name.isalnum() else (False, i)

    def movie(i: int) -> tuple[bool, int]:
        more, place = step(i)
        return (False, 1) if more and b[i + 4 : i + 8] == b"moov" else (more, place if more else 0)

    return body.follow("mp4", at, step) - at if body.follow("moov", at, movie) else 0


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/ogg": _ogg, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf, "video/mp4": _mp4}


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each validated medium, by offset; media inside another's extent count too."""
    body, found = Body(data), []
    for at, kind in sorted(body.hits, reverse=True):
        if length := VALID[kind](body, at):
            found.append((at, length, RIFF_KINDS[data[at + 8 : at + 12]] if kind == "riff" else kind))
    return found[::-1]


def store(payload: bytes, kind: str) -> bytes:
    """A payload of whole rows of 192 bytes as 8-bit samples: one channel of sound, or one grey value a pixel."""
    rows = len(payload) // ROW
    if kind == "audio/wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == "image/bmp":  # a negative height: rows from the top
        grey = np.repeat(np.arange(256, dtype=np.uint8), 4).tobytes()
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, ROW, -rows, 1, 8, 0, len(payload), 0, 0, 256, 0) + grey + payload
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples of what store() made."""
    if kind == "audio/wav":
        return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]
    if kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    i, body = 8, []
    while i < len(data):
        n, name = struct.unpack_from(">I4s", data, i)
        if name == b"IDAT":
            body.append(data[i + 8 : i + 8 + n])
        i += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


def sniff_media(df: DataFrame, data: str, declared: str, *keep: str) -> DataFrame:
    """Adds to the kept columns: media_type (corrected), media_length (of the medium at the start, else null), was_wrong,
    and embedded, an array of (offset, length, type, bytes)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds, sizes, wrong, inside = [], [], [], []
            for body, said in zip(raw(part.column(data)), part.column(declared).to_pylist(), strict=True):
                found = sniff(body)
                kind, size = next(((k, n) for at, n, k in found if at == 0), ("application/octet-stream", None))
                kinds.append(kind)
                sizes.append(size)
                wrong.append(kind != said)
                inside.append([{"offset": a, "length": n, "media_type": k, "bytes": body[a : a + n]} for a, n, k in found if a])
            own = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(inside, pa.list_(inner))], [*keep, "media_type", "media_length", "was_wrong", "embedded"])

    inner = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("bytes", pa.binary())])
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "media_type string, media_length long, was_wrong boolean, embedded array<struct<offset:bigint,length:bigint,media_type:string,bytes:binary>>"])
    return df.select(*dict.fromkeys([*keep, data, declared])).mapInArrow(run, schema)


STORED = ("audio/wav", "image/bmp", "image/png")
#: Foreign bytes around a medium: an upload's part header and its end; bytes like a magic number's that are none.
ENVELOPE = b"--part\r\nContent-Type: text/plain\r\n\r\nBM PK\x03\x04 %PDF- GIF89a RIFF OggS ftyp\r\n", b"\r\n--part--\r\n"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_type", pa.string()), ("was_wrong", pa.bool_()), ("media_at", pa.int64()), ("n_embedded", pa.int64())])


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, body and declared of each text: a medium whose form follows from the payload's length.

    Every type is declared wrongly. By the payload's rows, a body is the medium, the medium with foreign bytes behind it,
    or an envelope of foreign bytes around it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("body", pa.binary()), ("declared", pa.string())])

    def one(doc_id: int | None, text: bytes) -> tuple:
        payload = text.ljust(max(1, -(-len(text) // ROW)) * ROW)
        rows = len(payload) // ROW
        media = store(payload, STORED[rows % 3])
        head, tail = ENVELOPE
        body = (media, media + tail, head + media + tail)[rows // 3 % 3]
        return doc_id, len(text), body, STORED[(rows + 1) % 3]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((one(i, t) for part in parts for i, t in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True)), schema, 200)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, body binary, declared string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text as a stored medium, sniffed or carved out of its body, read back and digested.

    Equal texts give equal values; null and empty texts give one row of 192 spaces.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def one(doc_id: int | None, n_bytes: int, body: bytes, kind: str, size: int | None, wrong: bool, inside: list[dict]) -> tuple:
        at, media, own = 0, body[: size or 0], kind
        if size is None:  # nothing at the start: the largest of what was carved in a form that is stored here
            best = max((x for x in inside if x["media_type"] in STORED), key=lambda x: x["length"])
            at, media, own = best["offset"], best["bytes"], best["media_type"]
        back = samples(media, own)
        values = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
        parts = ";".join(f"{x['media_type']}@{x['offset'] - at}+{x['length']}" for x in inside)
        feature = f"{own}|{len(back) // ROW}x{ROW}|levels={np.count_nonzero(values)}|mean={int(values @ np.arange(256)) // len(back)}|{parts}"
        return doc_id, n_bytes, len(back), sha(back), zlib.crc32(back[-16:]), len(media), sha(media), feature, kind, wrong, at, len(inside)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((one(*row) for part in parts for row in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True)), _DIGEST)

    found = sniff_media(stored_media(docs), "body", "declared", "doc_id", "n_bytes", "body")
    columns = found.select("doc_id", "n_bytes", "body", "media_type", "media_length", "was_wrong", "embedded")
    return columns.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, was_wrong boolean, media_at long, n_embedded long")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))

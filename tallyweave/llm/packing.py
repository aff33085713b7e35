"""Token ids in files, by fixed-width bit packing.

Each id takes the fewest bits that the vocabulary needs. A file is Parquet: a row is one block of whole documents with
about BLOCK ids, its place (``shard``, ``first_id``: ids of the shard before it), the ids of its documents, where each
of them ends, and the packed bits. Shards hold consecutive ranges of doc_id, so the ids of a corpus are those of its
blocks in the order of (shard, first_id), and any range of ids is found by block and read alone.

Edge cases: null texts count as empty, so their only id is the end id; null doc_ids sort first; rows that share a
doc_id are ordered by text; a table without rows gives files without rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WIDE_SPACE
from .common import batches, documents, scratch_dir

BLOCK = 1 << 16
CACHE = 400_000
END_ID = 0
FILE = "byte_bpe_50k.json"

_BLOCKS = pa.schema([("shard", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("packed", pa.binary())])
_BLOCKS_SQL = "shard int, first_id long, n_ids long, bits int, doc_ids array<long>, ends array<long>, packed binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids below 2**bits, the lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(packed: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on, without unpacking those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    first = start * bits
    flat = np.unpackbits(np.frombuffer(packed, np.uint8, -(-(first + n * bits) // 8) - first // 8, first // 8), bitorder="little")
    return flat[first % 8 : first % 8 + n * bits].reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _visible() -> str:
    """The library's form of the 256 bytes: printable Latin-1 characters stand for themselves, the others for those from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in kept else next(other)) for b in range(256))


class LibraryEncoder(dict):
    """The tokenizers library's ids of a text; words that stand between single spaces are encoded once and kept.

    Such a word falls into matches of the pattern; the library's model encodes each match, in its form of bytes, once.
    Other texts, and those with an added token's string, go through the library whole.
    """

    VISIBLE = _visible()
    MARKS = ".,;:!?#$%&*|<>"  # none of them a letter, a digit or a space: together they are one match

    def __init__(self, data: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        self.model, self.split, self.tails = self.library.model, regex.compile(public_tokenizers.PATTERN).findall, {}
        added = [re.escape(x["content"]) for x in json.loads(data).get("added_tokens") or [] if x["content"]]
        self.added = re.compile("|".join(added) or r"(?!)")  # the library cuts a text at these before all else

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.VISIBLE)[0])]
        return array("I", ids).tobytes()

    def tail(self, marks: str) -> bytes:
        if (value := self.tails.get(marks)) is None:
            value = self.piece(marks)
            if len(marks) <= 4:
                self.tails[marks] = value
        return value

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one match, with the space before it
            value = self.piece(" " + word)
        elif (core := word.rstrip(self.MARKS)).isalpha():
            value = self[core] + self.tail(word[len(core) :])
        else:
            value = b"".join(map(self.piece, self.split(word if word[:1] == "\n" else " " + word)))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value

    def ids(self, text: str) -> np.ndarray:
        if not text or WIDE_SPACE.search(text) or self.added.search(text):
            return np.frombuffer(self.whole(text), "<u4")
        first, *rest = text.replace("\n", " \n").split(" ")
        return np.frombuffer(b"".join([self.whole(first), *map(self.__getitem__, rest)]), "<u4")


_ENCODERS: dict[str, LibraryEncoder] = {}


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Encode every text and write the blocks in ascending doc_id order."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(data := f.read())  # a file of fixed size
    from tokenizers import Tokenizer

    bits = max(1, (Tokenizer.from_str(data).get_vocab_size() - 1).bit_length())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = LibraryEncoder(shared.value)
        encode, end = _ENCODERS[tokenizer].ids, np.array([end_id], np.uint32)

        def blocks() -> Iterator[tuple]:
            shard, first, held, names, ends = TaskContext.get().partitionId(), 0, [], [], [0]
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held += [ids := encode(text or ""), end]
                    names.append(doc_id)
                    ends.append(ends[-1] + len(ids) + 1)
                    if ends[-1] >= BLOCK:
                        yield shard, first, ends[-1], bits, names, ends[1:], pack_bits(np.concatenate(held), bits)
                        first, held, names, ends = first + ends[-1], [], [], [0]
            if names:
                yield shard, first, ends[-1], bits, names, ends[1:], pack_bits(np.concatenate(held), bits)

        yield from batches(blocks(), _BLOCKS, 16)

    docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _BLOCKS_SQL).write.parquet(folder)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard. One row for each written file, so the one ordered window is as short as the list of files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS_SQL).parquet(folder)


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """n ids from a place in the corpus: only the blocks that hold them are read, only those ids unpacked."""
    blocks = read_blocks(spark, folder)
    placed = blocks.join(shard_starts(blocks), "shard").withColumn("at", F.col("shard_start") + F.col("first_id"))
    rows = placed.where((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start)).orderBy("at").collect()
    cut = lambda r: (max(start - r["at"], 0), min(start + n, r["at"] + r["n_ids"]) - r["at"])
    return np.concatenate([np.zeros(0, np.uint32), *(unpack_bits(r["packed"], r["bits"], a, b - a) for r in rows for a, b in [cut(r)])])


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents_of() -> Iterator[tuple]:
            for part in parts:
                for row in part.to_pylist():
                    ids, at = unpack_bits(row["packed"], row["bits"], 0, row["n_ids"]).astype("<u4"), 0
                    for doc_id, end in zip(row["doc_ids"], row["ends"], strict=True):
                        yield row["shard"], doc_id, row["first_id"] + at, end - at, zlib.crc32(ids[at:end].tobytes())
                        at = end

        yield from batches(documents_of(), schema, 10_000)

    blocks = read_blocks(spark, folder)
    found = blocks.mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(blocks), "shard").select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    write_ids(documents(spark, sf_dir), public_tokenizers.path(FILE), folder)
    return read_digest(spark, folder)

"""Target-distribution importance resampling: draws the documents whose n-grams look most like a target's.

Weights: features are runs of 1 to MAX_RUN words, hashed into BUCKETS by crc32 (the checksum of a run follows from those of
its words and their lengths, so that no run is ever written out). One pass adds up the counts of all documents and of the
target, an array of BUCKETS numbers for each task; their smoothed log ratio is a bucket's gain, and a document's weight the
sum of its features' gains. A score is the weight and a Gumbel draw by doc_id, so that the highest scores are a sample
without replacement.

Draw: the k-th key is found by a distributed quickselect over the composite key (score falling, doc_id, the rest). Each
round takes PIVOTS random keys from the range that is still open, counts the rows below, at and between them exactly, and
goes on in the part that holds the k-th; it ends at the pivot that is the k-th key. Only rows up to that key are dealt out by
range, sorted and ranked, equal rows once with their number. The driver sees pivots, counts and gains, never documents.

Edge cases: null texts have no words, no features and weight 0; an item of the target without a word adds nothing; an
empty target leaves smoothed gains; a null doc_id draws by empty text and comes last among ties; repeated rows have one
key, get ranks one after another, and are drawn one by one where the last rank falls among them; an empty table gives no
rows; extra columns are ignored by the query and kept by resampled(), which compares rows by all columns that have a hash.
A single text is held whole, about 40 bytes for each of its words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, quoted, raw

MAX_RUN, BUCKETS = 3, 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
PIVOTS = 16
CACHE, CHUNK = 300_000, 200_000
#: Longer words than this are appended to a checksum one by one.
TABLED = 48

#: A-Z in lower case, ASCII characters besides letters and digits as spaces; all other bytes belong to words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
KEY = ("fall", "no_id", "doc_id", "n_features", "row_key")


def _shift_tables() -> np.ndarray:
    """[length, byte of the checksum, its value]: what a checksum becomes when so many bytes follow, before they are mixed in."""
    out = np.zeros((TABLED + 2, 4, 256), np.uint32)
    for n in range(TABLED + 2):
        zeros = bytes(n)
        base = zlib.crc32(zeros)
        for k in range(4):
            for bit in range(8):
                one = zlib.crc32(zeros, 1 << (8 * k + bit)) ^ base
                out[n, k, 1 << bit : 2 << bit] = out[n, k, : 1 << bit] ^ np.uint32(one)
    return out


_SHIFT = _shift_tables()


class Words(dict):
    """Numbers words as they come; checksum of each, of each after a space, and length."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.own, self.next, self.text = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.own)
        self.own.append(zlib.crc32(word)), self.next.append(zlib.crc32(b" " + word)), self.text.append(word)
        return n


def appended(before: np.ndarray, word: np.ndarray, words: Words, after_space: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of runs, a space and a word, from the checksums of the runs."""
    n = np.minimum(length[word] + 1, TABLED + 1)
    out = after_space[word].copy()
    for k in range(4):
        out ^= _SHIFT[n, k, before >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(length[word] > TABLED).tolist():
        out[i] = zlib.crc32(b" " + words.text[word[i]], int(before[i]))
    return out


def featured(texts: Iterator[tuple], words: Words) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """From (key, text) in chunks: keys, numbers of words, and of each feature the place of its text and its bucket."""
    keys, sizes, ids, total = [], [], [], 0

    def chunk() -> tuple:
        n = np.array(sizes, np.int64)
        w = np.concatenate([np.zeros(0, np.int64), *ids])
        own, after, length = np.array(words.own, np.uint32), np.array(words.next, np.uint32), np.array(list(map(len, words.text)), np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        run = own[w] if len(w) else np.zeros(0, np.uint32)
        owners, found, at = [owner], [run], np.arange(len(w))
        for k in range(1, MAX_RUN):
            inside = np.flatnonzero(at + k < len(w))
            inside = inside[owner[at[inside]] == owner[at[inside] + k]]
            at = at[inside]
            run = appended(run[inside], w[at + k], words, after, length) if len(at) else np.zeros(0, np.uint32)
            owners.append(owner[at]), found.append(run)
        return keys, n, np.concatenate(owners), np.concatenate(found) % np.uint32(BUCKETS)

    for key, text in texts:
        found = text.translate(PLAIN).split()
        keys.append(key), sizes.append(len(found)), ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
        total += len(found)
        if total >= CHUNK or len(keys) >= CHUNK:
            yield chunk()
            keys, sizes, ids, total = [], [], [], 0
            if len(words) > CACHE:
                words.reset()
    if keys:
        yield chunk()


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts each bucket has; one array a task is added up, BUCKETS numbers reach the driver."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for _, _, _, bucket in featured(((None, t) for p in parts for t in raw(p.column(0))), Words()):
            counts += np.bincount(bucket, minlength=BUCKETS)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to all, rounded down."""
    s_all, t_all = float(all_counts.sum()) + BUCKETS, float(target_counts.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(all_counts.tolist(), target_counts.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, n_words, n_features, weight and score of each row, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))  # BUCKETS numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value, Words()
        for p in parts:
            numbered = enumerate(raw(p.column("text")))
            for places, n, owner, bucket in featured(numbered, words):
                weight = np.rint(np.bincount(owner, weights=own[bucket], minlength=len(n))).astype(np.int64)  # whole numbers below 2**53
                rows = p.select(["doc_id", "row_key"]).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n), pa.array(np.bincount(owner, minlength=len(n)).astype(np.int64)), pa.array(weight)], ["doc_id", "row_key", "n_words", "n_features", "weight"])

    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select("doc_id", F.xxhash64(*quoted(plain)).alias("row_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, row_key long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return materialize(found.withColumn("score", (F.col("weight") + draw).cast("long")))


def _with_key(rows: DataFrame) -> DataFrame:
    return rows.select("*", (-F.col("score")).alias("fall"), F.col("doc_id").isNull().alias("no_id"))


def _literal(rows: DataFrame, key: tuple) -> Column:
    return F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(KEY, key, strict=True)))


def kth_key(rows: DataFrame, k: int) -> tuple[tuple, int]:
    """The k-th least key of rows (from _with_key) and how many rows have a lesser one."""
    low, high, below = None, None, 0
    for turn in range(1 << 30):
        inside, key = rows, F.struct(*KEY)
        if low is not None:
            inside = inside.where(key > _literal(rows, low))
        if high is not None:
            inside = inside.where(key < _literal(rows, high))
        drawn = inside.select(*KEY).orderBy(F.xxhash64(*KEY, F.lit(turn))).limit(PIVOTS).collect()
        pivots = sorted({tuple(r) for r in drawn}, key=lambda p: (p[0], p[1], 0 if p[2] is None else p[2], *p[3:]))
        marks = [(key > _literal(rows, p)).cast("int") * 2 + (key == _literal(rows, p)).cast("int") for p in pivots]
        counts = {r["place"]: r["n"] for r in inside.groupBy(reduce(add, marks).alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for place in range(2 * len(pivots) + 1):
            n = counts.get(place, 0)
            if below + n >= k:
                break
            below += n
        if place % 2:
            return pivots[place // 2], below
        low = pivots[place // 2 - 1] if place else low
        high = pivots[place // 2] if place // 2 < len(pivots) else high
    raise AssertionError("no end")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The rows (from scored(), all that may be drawn) with rank 1 to k by key, null after that; their order is open."""
    kept = ["doc_id", "row_key", "n_features", "weight", "score"]
    if not k:
        return rows.select(*kept, F.lit(None).cast("long").alias("rank"))
    rows = _with_key(rows)
    last, below = kth_key(rows, k)
    key, end = F.struct(*KEY), _literal(rows, last)
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), k // 200_000)
    own = rows.where(key <= end).groupBy(*KEY, "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    own = own.withColumn("taken", F.when(key == end, F.lit(k - below)).otherwise(F.col("copies")))
    dealt = materialize(own.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("taken").alias("taken"))  # one row for each range
    ahead = parts.select("part", F.coalesce(F.sum("taken").over(before.orderBy("part")), F.lit(0)).alias("ahead"))
    start = F.col("ahead") + F.coalesce(F.sum("taken").over(before.partitionBy("part").orderBy(*KEY)), F.lit(0))
    step = 1 << 16
    runs = dealt.join(ahead, "part").select(*kept, "copies", "taken", start.alias("start"))
    runs = runs.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(step).cast("long"))))
    each = runs.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + (step - 1), F.col("copies")))))
    drawn = each.select(*kept, F.when(F.col("i") <= F.col("taken"), F.col("start") + F.col("i")).alias("rank"))
    return drawn.unionByName(rows.where(key > end).select(*kept, F.lit(None).cast("long").alias("rank")))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, row_key, n_features, weight, score and rank (null: not drawn) of every row."""
    rows = scored(docs, target, seed)
    able = rows.where(F.col("n_words") >= min_words)
    rest = rows.where(F.col("n_words") < min_words).select("doc_id", "row_key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(able, percent * able.count() // 100).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs with all their columns. Of equal rows as many as were drawn; any of them, as they are equal."""
    found = importance_ranks(docs, target, percent, min_words, seed).where("rank IS NOT NULL")
    drawn = materialize(found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.xxhash64(*quoted(plain)).alias("row_key")).join(drawn, "row_key")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return rows.select("row", "n", place.alias("place")).where("place <= n").select("row.*")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_ranks(documents(spark, sf_dir), target).drop("row_key")

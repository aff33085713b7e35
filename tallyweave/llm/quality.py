"""Quality classifier by Bradley-Terry pairwise ranking.

A text has a vector of statistics. Its worth is a weighted sum of them, learned from pairs of a text marked 1 and one
marked 0 by logistic loss on the difference of their vectors, so that the first is worth more. The threshold is the
quantile of worths at the share of 0, both over all labelled rows; scores are a logistic curve of worth that is 0.3 there.

The weights are fitted on up to MAX_LABELLED labelled rows, taken by hash: that bound is the only limit, texts are used
whole. The quantile is exact to one rank in ACCURACY.

Edge cases: null texts count as empty and are scored as such; without labels of both kinds each score is 0.5; a
doc_id labelled twice has its lower label; repeated rows give repeated results; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, discard, doc_crc, documents, hash_share, materialize, mix, quoted, raw

MAX_LABELLED, PAIRS, STEPS = 20_000, 40_000, 25
CUT, ACCURACY = 0.3, 1_000_000
CACHE = 300_000
FEATURES = ("log_words", "word_length", "distinct", "repeated_windows", "repeated_next", "capitals", "digits", "exclamations", "symbols", "bars", "stops", "line_ends", "other_marks", "letters", "repeated_lines")


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def repeated_windows(h: np.ndarray) -> np.ndarray:
    """Marks the words in 3-word windows that occur twice or more."""
    marked = np.zeros(len(h), bool)
    if len(h) > 3:
        w = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        marked[:-2] |= twice
        marked[1:-1] |= twice
        marked[2:] |= twice
    return marked


def vector(text: bytes, words: WordHash) -> list[float]:
    found = text.split()
    n = max(len(found), 1)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    symbols, bars = c[[35, 42, 36, 37, 38, 60, 62]].sum(), c[124]
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    size = max(len(text), 1)
    lines = [x for x in text.split(b"\n") if x]
    return [
        np.log1p(len(found)), min(size / n, 20.0), len(set(found)) / n if found else 1.0, repeated_windows(h).mean() if found else 0.0, (h[1:] == h[:-1]).sum() / n, upper / max(upper + lower, 1),
        digits / size, min(c[33] / n, 1.0), min(symbols / n, 1.0), min(bars / n, 1.0), min((c[44] + c[46]) / n, 1.0), min(c[10] / n, 1.0),
        min((marks - symbols - bars - c[33] - c[44] - c[46]) / n, 1.0), (upper + lower + high) / size, 1 - len(set(lines)) / max(len(lines), 1),
    ]


def known_labels(labels: DataFrame, allowed: Column) -> DataFrame:
    """doc_id and its (lower) quality."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(allowed)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_LABELLED) -> DataFrame:
    """text and quality of about ``bound`` labelled rows; only their labels, of that bound, are broadcast."""
    known = known_labels(labels, allowed)
    taken = known.where(hash_share(F.col("doc_id"), known.count(), bound))
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "quality")


class Model:
    """What texts are worth."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.mean, self.scale, self.weight = mean, scale, weight

    def worth(self, texts: list[bytes], words: WordHash) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return shaped(np.array([vector(t, words) for t in texts]), self.mean, self.scale) @ self.weight


def shaped(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.concatenate([z, z * z], 1)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_LABELLED) -> Model | None:
    schema = pa.schema([("x", pa.list_(pa.float64())), ("quality", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        yield from batches(((vector(t, words), q) for p in parts for t, q in zip(raw(p.column(0)), p.column(1).to_pylist(), strict=True)), schema)

    sample = labelled_sample(docs, labels, allowed, bound).select("text", F.col("quality").cast("int").alias("quality"))
    rows = sorted((r["quality"], tuple(r["x"])) for r in sample.mapInArrow(run, "x array<double>, quality int").collect())  # at most about ``bound`` short vectors
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    if not len(rows) or not 0 < y.sum() < len(y):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = shaped(x, mean, scale)
    draw = np.random.default_rng(7)
    diff = z[draw.choice(np.flatnonzero(y == 1), PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), PAIRS)]
    w, ridge = np.zeros(z.shape[1]), 0.01
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # how far each pair is from certain
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + ridge * np.eye(len(w)), diff.T @ p / PAIRS - ridge * w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return Model(mean, scale, w)


def worths(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and worth of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for p in parts:
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(shared.value.worth(raw(p.column(1)), words), pa.float64())], ["doc_id", "worth"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, worth double")


def threshold(found: DataFrame, labels: DataFrame, allowed: Column) -> float:
    """The worth below which as many of all labelled rows lie as are labelled 0."""
    known = found.join(known_labels(labels, allowed), "doc_id")
    share = known.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    cut = known.agg(F.percentile_approx("worth", F.lit(share), F.lit(ACCURACY))).first()[0] if share is not None else 0.0
    return float(np.nextafter(cut, np.inf))  # the row at the quantile itself is one of those below


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose crc32(doc_id) mod 5 is not 0, scores all."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = doc_crc(F.col("doc_id")) % 5 == 0
    if model := fit(docs, labels, ~out):
        found = materialize(worths(docs, model))
        above = F.col("worth") - F.lit(threshold(found, labels, ~out))
        score = 1 / (1 + F.exp(-F.least(F.greatest(above + F.lit(float(np.log(CUT / (1 - CUT)))), F.lit(-40.0)), F.lit(40.0))))
    else:
        found, score, above = docs.select("doc_id"), F.lit(0.5), F.lit(0.0)
    # the score at the threshold itself is CUT, but for rounding
    found = found.select("doc_id", F.when(above >= 0, F.greatest(score, F.lit(CUT))).otherwise(F.least(score, F.lit(float(np.nextafter(CUT, 0))))).alias("score"))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_enough(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns; all of them without a model."""
    model = fit(docs, labels, allowed)
    if model is None:
        return docs
    found = materialize(worths(docs, model))
    cut = threshold(found, labels, allowed)
    discard(found)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for p in parts:
            yield p.select(["row"]).filter(pa.array(shared.value.worth(raw(p.column("text")), words) >= cut, pa.bool_()))

    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), "text")
    return rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType)).select("row.*")

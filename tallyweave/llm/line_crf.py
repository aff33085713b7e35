"""Quality rules with line labelling.

Base rules count words, symbols, repeated lines and repeated 3-word windows. Then a linear-chain conditional random
field marks each line of a text content or boilerplate, by Viterbi over marks of the line (symbols, capitals, repeats,
bars and so on) and of neighbouring labels; a text stays if content lines hold at least CONTENT of its words.

The field is trained here, on up to MAX_LABELLED labelled rows taken by hash, each with up to PIECES runs of LINES lines
spread evenly over the whole text; these bounds are the only limits, and only of training. Lines of rows labelled 1 are
content. Which lines of rows labelled 0 are boilerplate is not known: at first all of them count so, then the field
labels them itself, and is fitted to that again, ROUNDS times. So it learns from texts whose labels change inside.

Edge cases: null texts count as empty: no words, base_failed; without labels of both kinds every line is content;
repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, documents, raw
from .quality import WordHash, labelled_sample, repeated_windows

MAX_LABELLED, PIECES, LINES = 6000, 4, 48
STEPS, ROUNDS, CONTENT = 60, 3, 0.7
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_OTHER = bytes(set(range(256)) - set(SYMBOLS))
_KEEP = {name: bytes(set(range(256)) - set(chars)) for name, chars in (("capitals", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("small", b"abcdefghijklmnopqrstuvwxyz"), ("digits", b"0123456789"), ("loud", b"!?"), ("symbols", b"#*$%&<>"), ("bars", b"|"))}
N_MARKS = 9


def line_marks(line: bytes, words: list[bytes], again: bool) -> list[float]:
    count = lambda name: len(line.translate(None, _KEEP[name]))
    n, capitals = len(words), count("capitals")
    return [1.0, min(count("symbols") / n, 1.0), min(count("bars") / n, 1.0), min(count("loud") / n, 1.0), capitals / max(capitals + count("small"), 1), min(count("digits") / n, 1.0), 1 - len(set(words)) / n, float(again), float(n < 4)]


def lines_of(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Marks and number of words of each line with a word, and how many of these repeat an earlier line."""
    marks, sizes, seen, again = [], [], set(), 0
    for line in text.split(b"\n"):
        if words := line.split():
            known = line in seen
            seen.add(line)
            again += known
            marks.append(line_marks(line, words, known))
            sizes.append(len(words))
    return marks, sizes, again


class Field:
    """emit: weight of each mark for boilerplate (label 1) against content (0); move: weight of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def labels(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all texts at once, longest first."""
        steps = _Steps([len(x) for x in texts])
        if not len(steps.active):
            return [np.zeros(0, np.int8) for _ in texts]
        e = steps.packed(np.concatenate(texts) @ self.emit)
        score = np.zeros((len(e), 2))
        score[:, 1] = e
        back, best = np.zeros((len(e), 2), np.int8), score[: steps.active[0]].copy()
        for t in range(1, len(steps.active)):
            k, span = steps.active[t], slice(steps.at[t], steps.at[t + 1])
            paths = best[:k, :, None] + self.move  # from, to
            back[span] = paths.argmax(1)
            best[:k] = paths.max(1) + score[span]
        label, out = best.argmax(1).astype(np.int8), np.zeros(len(e), np.int8)
        for t in range(len(steps.active) - 1, -1, -1):
            k = steps.active[t]
            out[steps.at[t] : steps.at[t + 1]] = label[:k]
            label[:k] = back[np.arange(steps.at[t], steps.at[t + 1]), label[:k]]
        return steps.unpacked(out)


class _Steps:
    """Sequences laid out by position: all first elements, all second ones, and so on; the longest sequence leads."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.order = np.argsort(-self.sizes, kind="stable")
        ranked = self.sizes[self.order]
        self.active = len(ranked) - np.searchsorted(ranked[::-1], np.arange(ranked[0] if len(ranked) else 0), "right")
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        rank = np.empty(len(ranked), np.int64)
        rank[self.order] = np.arange(len(ranked))
        own = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.where = self.at[np.arange(len(own)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)] + rank[own]

    def packed(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.where] = flat
        return out

    def unpacked(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values[self.where], np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


def train(texts: list[np.ndarray], labels: list[np.ndarray], start: Field | None = None) -> Field:
    """Gradient ascent (Adam) on the mean log likelihood of label sequences, from another field's weights if given."""
    steps = _Steps([len(x) for x in texts])
    x = steps.packed(np.concatenate(texts))
    y = steps.packed(np.concatenate(labels).astype(np.int64))
    w, n = np.concatenate([start.emit, start.move.ravel()]) if start else np.zeros(N_MARKS + 4), len(y)
    m, v = np.zeros_like(w), np.zeros_like(w)
    pairs = np.zeros((2, 2))
    for own in labels:
        np.add.at(pairs, (own[:-1], own[1:]), 1)
    seen = np.concatenate([x.T @ y, pairs.ravel()])
    add = lambda a, b: np.logaddexp(a, b)
    for i in range(1, STEPS + 1):
        move, score = w[N_MARKS:].reshape(2, 2), np.zeros((n, 2))
        score[:, 1] = x @ w[:N_MARKS]
        ahead, behind = score.copy(), np.zeros((n, 2))
        for t in range(1, len(steps.active)):
            k, now, was = steps.active[t], slice(steps.at[t], steps.at[t + 1]), steps.at[t - 1]
            p = ahead[was : was + k]
            ahead[now] += add(p[:, :1] + move[0], p[:, 1:] + move[1])
        for t in range(len(steps.active) - 1, 0, -1):
            k, now, was = steps.active[t], slice(steps.at[t], steps.at[t + 1]), steps.at[t - 1]
            q = behind[now] + score[now]
            behind[was : was + k] = add(q[:, :1] + move[:, 0], q[:, 1:] + move[:, 1])
        total = ahead + behind
        p1 = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -40, 40)))
        expected = np.zeros((2, 2))
        for t in range(1, len(steps.active)):
            k, now, was = steps.active[t], slice(steps.at[t], steps.at[t + 1]), steps.at[t - 1]
            both = ahead[was : was + k, :, None] + move + (behind[now] + score[now])[:, None, :]
            norm = add(total[now][:, 0], total[now][:, 1])
            expected += np.exp(both - norm[:, None, None]).sum(0)
        g = (seen - np.concatenate([x.T @ p1, expected.ravel()])) / n - 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(w[:N_MARKS], w[N_MARKS:].reshape(2, 2))


def learn(texts: list[np.ndarray], good: np.ndarray, rounds: int = ROUNDS) -> Field:
    """texts: marks of lines; good: which texts are labelled 1. Labels of the others' lines are found on the way."""
    labels = [np.full(len(x), int(not g), np.int8) for x, g in zip(texts, good, strict=True)]
    field, bad = train(texts, labels), np.flatnonzero(~good)
    for _ in range(rounds):
        alone = Field(field.emit, np.zeros((2, 2)))  # by marks only: the weights of changes are to follow from the labels found
        for i, own in zip(bad, alone.labels([texts[i] for i in bad]), strict=True):
            labels[i] = own
        field = train(texts, labels, field)
    return field


def pieces_of(marks: list[list[float]]) -> list[np.ndarray]:
    """All lines, or PIECES runs of LINES of them, the first and the last at the ends of the text."""
    x = np.array(marks, np.float32).reshape(-1, N_MARKS)
    if len(x) <= PIECES * LINES:
        return [x] if len(x) else []
    return [x[a : a + LINES] for a in np.linspace(0, len(x) - LINES, PIECES).astype(int)]


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_LABELLED) -> Field | None:
    schema = pa.schema([("x", pa.binary()), ("quality", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((x.tobytes(), q) for p in parts for t, q in zip(raw(p.column(0)), p.column(1).to_pylist(), strict=True) for x in pieces_of(lines_of(t)[0])), schema, 200)

    sample = labelled_sample(docs, labels, allowed, bound).select("text", F.col("quality").cast("int").alias("quality"))
    # at most PIECES * LINES times N_MARKS numbers for each of about ``bound`` rows
    rows = sorted((r["quality"], bytes(r["x"])) for r in sample.mapInArrow(run, "x binary, quality int").collect())
    good = np.array([r[0] != 0 for r in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return None
    return learn([np.frombuffer(r[1], np.float32).reshape(-1, N_MARKS).astype(np.float64) for r in rows], good)


def rules(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([*((c, pa.int64()) for c in names), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHash(), shared.value

        def one(doc_id: int | None, text: bytes) -> tuple:
            found = text.split()
            n = len(found)
            chars = len(text.translate(None, SPACES)) - len(text.translate(None, _NOT_TAILS))
            repeated = int(repeated_windows(np.fromiter(map(words.__getitem__, found), np.uint64, n)).sum())
            marks, sizes, again = lines_of(text)
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            return (doc_id, n, chars, len(text.translate(None, _OTHER)), again, repeated, failed), np.array(marks).reshape(-1, N_MARKS), np.array(sizes)

        for p in parts:
            rows = [one(i, t) for i, t in zip(p.column(0).to_pylist(), raw(p.column(1)), strict=True)]
            labels = own.labels([x for _, x, _ in rows]) if own else [np.zeros(len(s), np.int8) for _, _, s in rows]
            share = [float(s[y == 0].sum() / s.sum()) if len(s) else 0.0 for (_, _, s), y in zip(rows, labels, strict=True)]
            yield from batches(((*r, not r[6] and c >= CONTENT, c) for (r, _, _), c in zip(rows, share, strict=True)), schema, 10_000)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double")


#: Bytes that don't continue a character: what is left without them is the number of bytes beyond one a character.
_NOT_TAILS = bytes([*range(128), *range(192, 256)])


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules(docs, fit(docs, labels, F.lit(True)))

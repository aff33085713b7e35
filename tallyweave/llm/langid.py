"""Language ID of mixed text.

The script of a word's letters leaves as candidates only languages that were written in it; words have log scores by
letter trigrams for each candidate; a Viterbi pass over the words of a text, with a penalty for each switch, labels
spans. A text's language is that of most of its words with letters, its score the share of them.

Fitted on up to PER_LANG labelled rows a language, taken by hash: that bound is the only limit, texts are used whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows every text is
``und``; ties go to the language that sorts first; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, doc_crc, documents, hash_share

PER_LANG = 4000
BUCKETS = 1 << 15
SWITCH = 6.0
CACHE = 250_000
#: Words that are labelled in one pass.
CHUNK = 2_000_000

#: First code point of runs of blocks, and their script.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other")]
_STARTS = np.array([x for x, _ in SCRIPTS])
_NAMES = sorted({x for _, x in SCRIPTS})
_CODES = np.array([_NAMES.index(x) for _, x in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    return _CODES[np.maximum(np.searchsorted(_STARTS, [ord(w[0]) for w in words], "right") - 1, 0)]


def letters_of(word: str) -> str:
    """Only letters: no digits of any kind, marks or symbols."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes of words with their ends marked, and the word of each."""
    body = np.frombuffer(f"_{'_'.join(words)}_".encode(), np.uint8)
    own = np.cumsum(body == 95)[:-2] - 1
    inside = body[1:-1] != 95
    x = body.astype(np.uint32)
    key = (x[:-2] * np.uint32(0x10001) ^ x[1:-1] * np.uint32(0x9E37) ^ x[2:] * np.uint32(0x85EB51)) * np.uint32(0xC2B2AE35)
    return (key >> np.uint32(17))[inside], own[inside]


class Model:
    """log_p: trigrams by language; by_script: which languages each script leaves."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.log_p = np.log((counts + 0.2) / (counts.sum(0) + 0.2 * BUCKETS)).astype(np.float32)
        seen = scripts / np.maximum(scripts.sum(0), 1)
        self.by_script = seen > 0.01
        self.by_script[~self.by_script.any(1)] = True


class _Words(dict):
    """Row of a word in the table of scores; the last column tells if it has a letter. Holds CACHE words and those of one part of a text."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.filled = model, 1  # row 0: a word without letters
        self.table = np.zeros((1, len(model.langs) + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        letters = [(w, x) for w in words if (x := letters_of(w))]
        self.update(dict.fromkeys(words, 0))
        if not letters:
            return
        grams, own = trigrams([x for _, x in letters])
        rows = np.ones((len(letters), len(self.model.langs) + 1), np.float32)
        for k in range(len(self.model.langs)):
            rows[:, k] = np.bincount(own, self.model.log_p[grams, k], len(letters))
        rows[:, :-1][~self.model.by_script[scripts_of([x for _, x in letters])]] = -1e4
        rows[:, :-1] -= rows[:, :-1].max(1, keepdims=True)
        if self.filled + len(rows) > len(self.table):  # grow ahead
            self.table = np.concatenate([self.table[: self.filled], np.zeros((self.filled + 2 * len(rows), self.table.shape[1]), np.float32)])
        self.table[self.filled : self.filled + len(rows)] = rows
        self.update(zip((w for w, _ in letters), range(self.filled, self.filled + len(rows)), strict=True))
        self.filled += len(rows)

    def scores(self, words: list[str]) -> np.ndarray:
        out = [np.zeros((0, self.table.shape[1]), np.float32)]
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            if len(self) > CACHE:
                self.clear()
                self.filled = 1
            self.learn([w for w in set(part) if w not in self])
            out.append(self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))])
        return np.concatenate(out)


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label of each position of each sequence; all sequences advance together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return [np.zeros(0, np.int8) for _ in scores]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate([scores[i] for i in order])
    starts = np.cumsum(sizes) - sizes
    ranks = np.repeat(np.arange(len(sizes)), sizes)
    where = at[np.arange(len(flat)) - starts[ranks]] + ranks
    packed = np.empty_like(flat)
    packed[where] = flat
    labels = packed.shape[1]
    own, back = np.arange(labels, dtype=np.int8), np.empty((len(flat), labels), np.int8)
    best = packed[: active[0]].copy()
    for t in range(1, steps):
        k = active[t]
        now, top = best[:k], best[:k].argmax(1).astype(np.int8)
        jump = best[np.arange(k), top] - switch
        stay = now >= jump[:, None]
        back[at[t] : at[t + 1]] = np.where(stay, own, top[:, None])
        best[:k] = np.where(stay, now, jump[:, None]) + packed[at[t] : at[t + 1]]
    label, path = best.argmax(1).astype(np.int8), np.empty(len(flat), np.int8)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        path[at[t] : at[t + 1]] = label[:k]
        if t:
            label[:k] = back[np.arange(at[t], at[t + 1]), label[:k]]
    flat_path, out = path[where], [None] * len(scores)
    for i, a, n in zip(order, starts, sizes, strict=True):
        out[i] = flat_path[a : a + n]
    return out


def fit(docs: DataFrame, labelled, per_lang: int = PER_LANG) -> Model:
    """docs: text and lang; labelled: the condition of rows that may be learned from."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0)))
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), n, per_lang))
    schema = pa.schema([("lang", pa.int32()), ("kind", pa.int32()), ("feature", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, scripts = np.zeros((BUCKETS, len(langs)), np.int64), np.zeros((len(_NAMES), len(langs)), np.int64)
        for part in parts:
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if words := [x for w in text.split() if (x := letters_of(w))]:
                    found[:, langs.index(lang)] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
                    scripts[:, langs.index(lang)] += np.bincount(scripts_of(words), minlength=len(_NAMES))
        out = [(k, kind, int(f), int(x[f, k])) for kind, x in ((0, found), (1, scripts)) for f, k in zip(*np.nonzero(x), strict=True)]
        yield from batches(out, schema, 50_000)

    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    table = rows.where(keep).select("text", "lang").mapInArrow(run, "lang int, kind int, feature int, n long").groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))
    for r in table.toLocalIterator():  # at most BUCKETS and the scripts for each language
        (scripts if r["kind"] else counts)[r["feature"], r["lang"]] = r["n"]
    return Model(langs, counts, scripts)


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_spans; and spans, an array of (lang, first word, number of words), if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())]
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([*fields, ("spans", pa.list_(span))] if with_spans else fields)

    def label(rows: list[tuple], own: Model) -> Iterator[tuple]:
        lettered = [s[:, -1] > 0 for _, s in rows]
        paths = viterbi([s[m, :-1] for (_, s), m in zip(rows, lettered, strict=True)], switch)
        for (doc_id, _), path, mask in zip(rows, paths, lettered, strict=True):
            if not len(path):
                yield (doc_id, "und", 0.0, 0, []) if with_spans else (doc_id, "und", 0.0, 0)
                continue
            n = np.bincount(path, minlength=len(own.langs))
            cuts = np.flatnonzero(np.diff(path)) + 1
            row = doc_id, own.langs[int(n.argmax())], float(n.max() / len(path)), len(cuts) + 1
            if with_spans:
                words, bounds = np.flatnonzero(mask), [0, *cuts.tolist(), len(path)]
                row += ([{"lang": own.langs[path[a]], "first": int(words[a]), "words": int(words[b - 1] - words[a] + 1)} for a, b in zip(bounds, bounds[1:])],)
            yield row

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = _Words(own)

        def found() -> Iterator[tuple]:
            held, n = [], 0
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.append((doc_id, words.scores((text or "").split() if own.langs else [])))
                    n += len(held[-1][1])
                    if n >= CHUNK:
                        yield from label(held, own)
                        held, n = [], 0
            yield from label(held, own)

        yield from batches(found(), schema)

    sql = "doc_id long, lang_pred string, score double, n_spans long" + ", spans array<struct<lang:string,first:bigint,words:bigint>>" * with_spans
    return docs.select("doc_id", "text").mapInArrow(run, sql)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 3 is not 1, predicts all."""
    docs = documents(spark, sf_dir)
    fold = doc_crc(F.col("doc_id")) % 3
    found = predict(docs, fit(docs, fold != 1))
    return found.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score", "n_spans")

"""op4_language and op10_quality held to plain loops over the same rows: counts, scores, paths, features, threshold."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import langid, quality

from .test_contracts import QUERIES, corpus, write

crc = lambda i: zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def rows():
    return [*corpus(), (600, "vel mor tis kan dul når vær glim frem skov ånd brød øst vel mor", None, "web"), (601, "бар vel 漢字 mor", None, None), (602, "a1b2 __ 7 x", None, None)]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, rows):
    return write(tmp_path_factory.mktemp("plain"), rows)


def hashed(a: int, b: int, c: int) -> int:
    key = (a * 0x10001 & 0xFFFFFFFF) ^ (b * 0x9E37 & 0xFFFFFFFF) ^ (c * 0x85EB51 & 0xFFFFFFFF)
    return (key * 0xC2B2AE35 & 0xFFFFFFFF) >> 17


def grams(word: str) -> list[int]:
    b = f"_{word}_".encode()
    return [hashed(*b[i : i + 3]) for i in range(len(b) - 2)]


def script(letter: str) -> str:
    return [name for start, name in langid.SCRIPTS if start <= ord(letter)][-1]


def test_op4_against_plain_loops(spark, sf_dir, rows):
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    letters = lambda w: "".join(x for x in w if x.isalpha()).lower()
    for i, text, lang, _ in rows:
        if text is not None and lang is not None and crc(i) % 3 != 1:
            for w in filter(None, map(letters, text.split())):
                counts[lang].update(grams(w))
                scripts[lang][script(w[0])] += 1
    langs = sorted(counts)
    p = {k: {g: math.log((n + 0.2) / (counts[k].total() + 0.2 * langid.BUCKETS)) for g, n in counts[k].items()} for k in langs}
    none = {k: math.log(0.2 / (counts[k].total() + 0.2 * langid.BUCKETS)) for k in langs}
    able = {s: [k for k in langs if scripts[k][s] / max(1, scripts[k].total()) > 0.01] or langs for s in {n for _, n in langid.SCRIPTS}}
    found = {r["doc_id"]: r for r in QUERIES["op4_language"](spark, sf_dir).collect()}
    mixed = 0
    for i, text, *_ in rows:
        scores = []
        for w in filter(None, map(letters, (text or "").split())):
            own = {k: sum(p[k].get(g, none[k]) for g in grams(w)) if k in able[script(w[0])] else -1e4 for k in langs}
            scores.append({k: v - max(own.values()) for k, v in own.items()})
        best = None
        for s in scores:
            back = best
            if back is None:
                best = {k: (s[k], (k,)) for k in langs}
                continue
            top = max(langs, key=lambda k: back[k][0])
            best = {}
            for k in langs:
                before = back[k] if back[k][0] >= back[top][0] - langid.SWITCH else (back[top][0] - langid.SWITCH, back[top][1])
                best[k] = (before[0] + s[k], (*before[1], k))
        r = found[i]
        if not scores:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        path = max((best[k] for k in langs), key=lambda x: x[0])[1]
        n = Counter(path)
        assert (r["lang_pred"], r["n_spans"]) == (max(langs, key=lambda k: n[k]), 1 + sum(a != b for a, b in zip(path, path[1:]))), i
        assert abs(r["score"] - max(n.values()) / len(path)) < 1e-9
        mixed += len(n) > 1
    assert mixed


def features(text: str) -> list[float]:
    b = text.encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", b) if x]
    n, size = max(len(w), 1), max(len(b), 1)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    count = lambda chars: sum(b.count(bytes([x])) for x in chars)
    upper, lower, digits, high = count(range(65, 91)), count(range(97, 123)), count(range(48, 58)), sum(x > 127 for x in b)
    symbols, bars, shouts, commas = count(b"#*$%&<>"), count(b"|"), count(b"!"), count(b",.")
    marks = count([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
    lines = [x for x in b.split(b"\n") if x]
    return [
        math.log1p(len(w)), min(size / n, 20), len(set(w)) / n if w else 1, len(twice) / n if w else 0, sum(x == y for x, y in zip(w, w[1:])) / n, upper / max(upper + lower, 1), digits / size, min(shouts / n, 1), min(symbols / n, 1),
        min(bars / n, 1), min(commas / n, 1), min(count(b"\n") / n, 1), min((marks - symbols - bars - shouts - commas) / n, 1), (upper + lower + high) / size, 1 - len(set(lines)) / max(len(lines), 1),
    ]


def test_op10_against_plain_loops(spark, sf_dir, rows):
    """The fitted weights are given; features, worths, threshold, scores and predictions follow by loops."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = quality.fit(docs, labels, allowed)
    worth = {}
    for i, text, *_ in rows:
        z = [max(-4.0, min(4.0, (x - m) / s)) for x, m, s in zip(features(text or ""), model.mean, model.scale, strict=True)]
        worth[i] = sum(a * b for a, b in zip([*z, *(x * x for x in z)], model.weight, strict=True))
    known = sorted(worth[i] for i, *_ in rows if crc(i) % 5 != 0)
    label = {i: int(len(t or "") > 300) for i, t, *_ in rows}
    zeros = sum(label[i] == 0 for i, *_ in rows if crc(i) % 5 != 0)
    cut = known[math.ceil(zeros / len(known) * len(known) - 1e-9) - 1]
    found = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    for i, *_ in rows:
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, worth[i] - cut + math.log(quality.CUT / (1 - quality.CUT))))))
        assert abs(found[i]["score"] - score) < 1e-6 and found[i]["held_out"] == (crc(i) % 5 == 0)
        if abs(worth[i] - cut) > 1e-9:
            assert found[i]["predicted"] == int(worth[i] > cut), i
    held = [(worth[i], label[i]) for i, *_ in rows if crc(i) % 5 == 0]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert np.mean(pairs) > 0.8

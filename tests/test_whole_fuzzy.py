"""The most similar values, of every written value, against all pairs."""

import random

from tallyweave import catalog
from tallyweave.operators import linkage
from tests.test_queries import DIR


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_top_of_all_pairs(spark):
    rng = random.Random(3)
    known = sorted({f"AT{i % 3}T{i}" for i in range(1, 900)} | {"A", "AB", "XYZ", "QWERTYUIOP", "QWERTYUIO"})
    written = sorted({*rng.sample(known, 40), "AT1TS2S", "AT2T1", "QWERTYUIPP", "B", "XY", "", "??????", "AT0T12345678"})
    expected = set()
    for w in written:
        near = [(1 - distance(w, v) / max(len(w), len(v)), v) for v in known if abs(len(w) - len(v)) <= 3]
        expected |= {(w, v, i + 1) for i, (sim, v) in enumerate(sorted((x for x in near if x[0] >= 0.6 - 1e-12), reverse=True)[:10])}
    one = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    found = linkage.fuzzy_top(one("w", written), one("v", known)).collect()
    assert sorted((r["w"], r["v"], r["rank"]) for r in found) == sorted(expected)


def test_j4_takes_every_written_value(spark):
    found = catalog.queries()["j4_fuzzy_topk"](spark, DIR)
    first = {r["w"]: r["v"] for r in found.where("rank = 1").collect()}
    plain = [w for w in first if "S" not in w]
    assert len(plain) > 100 and all(first[w] == w for w in plain)

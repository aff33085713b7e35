"""Pairs that are many more than rows: scored and formed without a table of them."""

import random

from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import linkage


def test_look_alikes_one_by_one(spark):
    """The same evidence as from batches of alignments."""
    draw = random.Random(7)
    text = lambda n: "".join(draw.choice("05O1I7XL") for _ in range(n))
    pairs = [(text(draw.randint(0, 6)), text(draw.randint(0, 6))) for _ in range(3000)] + [("L40X40X3", "L45X45X3"), ("AB12", "B12A"), ("12AB", "AB12"), ("ß1", "SS1"), (None, "A")]
    df = spark.createDataFrame(pairs, "a string, b string")
    form = similarity.look_alike_form
    one = similarity.near_look_alike(F.col("a"), F.col("b"), form(F.col("a")), form(F.col("b")))
    got = df.select("a", "b", F.coalesce(one, F.lit(0.0)).alias("one"), similarity.look_alike_evidence(F.col("a"), F.col("b")).alias("many")).collect()
    assert [tuple(r) for r in got if r["one"] != r["many"]] == [] and any(0 < r["one"] < 0.85 for r in got)


def codes(spark):
    draw, kind = random.Random(3), "sheet_uid string, pos long, of_eff string, ov_eff string, perfil_eff string, modelo_written string"
    some = lambda *xs: draw.choice([*xs, None])
    rows = [(f"s{i}", i % 3, some("20000O", "200001", "999"), some("17", "OV18", "99"), some("40x40x3", "L45X45X3", "?"), some("AT1T1S", "AT1T15", "zz")) for i in range(80)]
    lines = [(f"k{i}", f"OF{200000 + i % 2}", some("OV17", "OV71", "OV18"), some("L40X40X3", "L45X45X3", "L50X50X5"), some("AT1T15", "AT2T15", "AT1T55")) for i in range(60)]
    return spark.createDataFrame(rows, kind), spark.createDataFrame(lines, "plan_key string, of_code string, ov string, perfil string, modelo string")


def test_rows_are_scored_where_they_meet_their_order(spark, monkeypatch):
    """As pairs that are written and joined value by value, in lists of any length."""
    monkeypatch.setattr(linkage, "LISTED", 7)
    rows, plan = codes(spark)
    expected = linkage.score_pairs(rows, plan, linkage.exact_candidates(rows, plan, "of_eff", "of_code"))
    monkeypatch.setattr(linkage, "settled", lambda df: 1 / 0)
    found = linkage.score_by_order(rows, plan)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str) and found.columns == expected.columns


def test_near_values_meet_in_lists(spark, monkeypatch):
    """All pairs of a plain loop, nulls and edges of buckets too; no row goes through the join by itself."""
    monkeypatch.setattr(linkage, "LISTED", 7)
    draw = random.Random(5)
    values = [(i, draw.choice([None, -0.75, 0.0, 1.5, 3.0, 3.1, draw.randint(-40, 40) / 10])) for i in range(120)]
    left, right = spark.createDataFrame(values, "a long, x double"), spark.createDataFrame(values, "b long, y double")
    found = linkage.tolerance_join(left, right, "x", "y", 1.5)
    near = sorted((a, x, b, y) for a, x in values for b, y in values if x is not None and y is not None and abs(x - y) <= 1.5)
    assert found.columns == ["a", "x", "b", "y"] and sorted(map(tuple, found.collect())) == near
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2 and plan.count("Join") == 1 and plan.index("Generate") < plan.index("Join")


def test_similar_values_keep_a_share_whatever_their_alignment_costs(spark):
    """Two other characters of ten cost 16 bits, yet the values are similar by 0.8: 0.3 of the weight, and no veto by a known value."""
    lines = [("k0", "OF200000", None, None, "AT1T120000"), ("k1", "OF200000", None, None, "AT1T123400"), ("k2", "OF200001", None, None, "AT1T555555")]
    plan = spark.createDataFrame(lines, "plan_key string, of_code string, ov string, perfil string, modelo string")
    rows = spark.createDataFrame([("s", 1, "200000", None, None, "AT1T120000")], "sheet_uid string, pos long, of_eff string, ov_eff string, perfil_eff string, modelo_written string")
    pairs = linkage.exact_candidates(rows, plan, "of_eff", "of_code")
    for scored in (linkage.score_by_order(rows, plan), linkage.score_pairs(rows, plan, pairs)):
        bits = {r["plan_key"]: r["bits"] for r in scored.collect()}
        own = {x["modelo"]: x["w_modelo"] for x in linkage.weights(plan, "modelo").collect()}
        order = {x["of_code"]: x["w_of_code"] for x in linkage.weights(plan, "of_code").collect()}["OF200000"]
        assert bits == {"k0": round(order * 1e6) + round(own["AT1T120000"] * 1e6), "k1": round(order * 1e6) + round(own["AT1T123400"] * 0.3 * 1e6)}

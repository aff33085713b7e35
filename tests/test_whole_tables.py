"""Queries that take whole tables, against plain loops; one-sided orders on a fixture."""

from collections import Counter

from tallyweave import catalog
from tallyweave.operators import reports
from tallyweave.sources.tables import Tables
from tests.test_queries import DIR

QUERIES = catalog.queries()


def test_j5_pairs_of_all_parts(spark):
    parts = [(r["p_partkey"], r["p_retailprice"]) for r in spark.read.parquet(f"{DIR}/part.parquet").collect()]
    expected = sorted((a, b) for a, x in parts for b, y in parts if abs(x - y) <= 1.5)
    assert sorted(map(tuple, QUERIES["j5_tolerance_join"](spark, DIR).collect())) == expected


def test_j2_cap_of_the_reference(spark):
    t = Tables(spark, DIR)
    lines = Counter(r["modelo"] for r in t.plan.collect())
    assert 35 < max(lines.values()) <= 500
    written = [r["modelo_written"] for r in t.rows.collect()]
    assert QUERIES["j2_exact_candidates_capped"](spark, DIR).count() == sum(lines[w] for w in written if w)


def test_j22_counts_every_line_and_fact(spark):
    t, found = Tables(spark, DIR), QUERIES["j22_plan_vs_validated"](spark, DIR).collect()
    assert sum(r["planned"] or 0 for r in found) == sum(r["qtd_planeada"] for r in t.plan.collect())
    assert sum(r["facts"] or 0 for r in found) == t.facts.count()
    assert not any(r["without_plan"] for r in found)


def test_j22_orders_of_one_side(spark):
    plan = spark.createDataFrame([("OF1", 5.0), ("OF2", 7.0)], "of_code string, qtd_planeada double")
    facts = spark.createDataFrame([("OF2", 1.0, None), ("OF3", None, None)], "of_code string, qtd double, sheet_date date")
    found = {r["of_code"]: (r["planned"], r["made"], r["facts"], r["without_plan"]) for r in reports.plan_against_facts(plan, facts).collect()}
    assert found == {"OF1": (5.0, None, None, False), "OF2": (7.0, 1.0, 1, False), "OF3": (None, None, 1, True)}

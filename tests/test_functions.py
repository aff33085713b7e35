"""Golden values of the written forms."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "number"), [("1.200", 1200.0), ("0.125", 0.125), ("1.234,56", 1234.56), ("", None), (None, None), ("x", None)])
def test_parse_number(spark, text, number):
    assert value(spark, N.parse_number(F.lit(text).cast("string"))) == number


def test_strict_decimal_takes_whole_values_only(spark):
    assert value(spark, N.parse_decimal(F.lit("1+1"))) is None
    assert value(spark, N.parse_decimal(F.lit("1 234,5")).cast("double")) == 1234.5


@pytest.mark.parametrize(
    ("text", "family", "dims", "key"),
    [
        ("60x5", "L", [60, 60, 5], "L60X60X5"),
        ("L 100x50x6", "L", [100, 50, 6], "L100X50X6"),
        ("Cantoneira 60 x 60 x 2,9", "L", [60, 60, Decimal("2.9")], "L60X60X2.9"),
        ("HEA 200", "HEA", [200], "HEA200"),
        ("Tubo Quadrado 40x40x3mm", "SQUARE", [40, 40, 3], "SQUARE40X40X3"),
        ("Q20x2", "ROUND", [20, 2], "20X2"),
        ("sem perfil", "", None, "SEMPERFIL"),
        ("", "", None, ""),
        (None, "", None, ""),
    ],
)
def test_parse_profile(spark, text, family, dims, key):
    p = value(spark, N.parse_profile(F.lit(text).cast("string")))
    assert (p["family"], p["dims"] and list(map(float, p["dims"])), p["key"]) == (family, dims and list(map(float, dims)), key)


def test_look_alikes_cost_less_than_other_letters(spark):
    cost = lambda a, b: value(spark, S.align_cost(F.lit(a), F.lit(b)))
    assert cost("AT1T515", "AT1TS15") == 2
    assert cost("AT1T515", "AT1T145") == 10
    assert cost("AT1", "") == 15


def test_date_that_does_not_exist_is_null(spark):
    assert value(spark, N.canonical_date(F.lit("31/2/2025"))) is None
    assert str(value(spark, N.canonical_date(F.lit("1.2.25")))) == "2025-02-01"


def test_costs_of_many_pairs_are_those_of_each(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("0OQD1IL75S8B6GAÉ漢😀 x") for _ in range(rng.choice([0, 1, 3, 7, 7, 8, 40])))
    pairs = [(word(), word()) for _ in range(300)] + [("0" * 5000, "O" * 4999), (None, "A"), ("A", None), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.where("length(a) < 100").select(S.align_cost(F.col("a"), F.col("b")).cast("long").alias("one"), S.align_cost_vector(F.col("a"), F.col("b")).alias("many")).collect()
    assert len(found) == 302 and all(r.one == r.many for r in found if r.many is not None)
    assert sum(r.many is None for r in found) == 1
    whole = [r.many for r in df.select(S.align_cost_vector(F.col("a"), F.col("b")).alias("many")).collect()]
    assert whole[300] == 2 * 4999 + 5 and whole[301:] == [None, None, 0]

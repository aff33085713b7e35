"""Rows whose order is unknown or misread: candidates of every field, look-alikes, veto, and no row lost."""

from tallyweave.operators import linkage
from tests.test_linkage import PLAN, ROWS

LINES = [
    ("1:1", "OF200001", "OV0000011", "L60X60X5", "AT1T1525"),
    ("2:2", "OF200002", "OV0000022", "L70X70X6", "AT2T7777"),
    ("3:3", "OF200003", "OV0000033", "L80X80X7", "BB9Z8888"),
]
SHEET = [
    ("ov", 1, None, "0000022", None, None, None, "1"),
    ("perfil", 1, None, None, "80x7", None, None, "1"),
    ("modelo", 1, None, None, None, "AT1T1S2S", None, "1"),
    ("order", 1, "200009", None, None, None, None, "1"),
    ("nothing", 1, None, None, None, "?", None, "1"),
    ("veto", 1, "200001", None, None, "AT2T7777", None, "1"),
]


def tables(spark):
    return spark.createDataFrame(SHEET, ROWS), spark.createDataFrame(LINES, PLAN)


def test_candidates_of_each_field(spark):
    rows, plan = tables(spark)
    found = {}
    for r in linkage.candidates(linkage.carry_down(rows), plan).collect():
        found.setdefault(r["sheet_uid"], []).append(r["plan_key"])
    assert "2:2" in found["ov"] and "3:3" in found["perfil"] and found["modelo"] == ["1:1"]
    assert sorted(found["order"]) == ["1:1", "2:2", "3:3"] and found["veto"] == ["1:1"] and "nothing" not in found


def test_every_row_comes_back(spark):
    got = {r["sheet_uid"]: r for r in linkage.link_all(*tables(spark)).collect()}
    assert {k: r["plan_key"] for k, r in got.items()} == {"ov": "2:2", "perfil": "3:3", "modelo": "1:1", "order": got["order"]["plan_key"], "nothing": None, "veto": "1:1"}
    assert (got["nothing"]["mode"], got["nothing"]["margin"], got["nothing"]["p"]) == ("no_match", 0, 0.0)
    weight = got["ov"]["bits"]  # one line of a thousand at least, as for every value here
    assert got["modelo"]["bits"] == round(weight * (1 - 4 / 12))  # two look-alikes of 2 bits each
    assert got["veto"]["bits"] == weight - 3_000_000  # the written model is another line's

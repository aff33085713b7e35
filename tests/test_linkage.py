"""Carrying down and linking on hand-made sheets."""

from tallyweave.operators import linkage

ROWS = "sheet_uid string, pos long, of_written string, ov_written string, perfil_written string, modelo_written string, perf_comp string, qtd_written string"
PLAN = "plan_key string, of_code string, ov string, perfil string, modelo string"


def test_ditto_blank_and_mute_rows(spark):
    rows = [("s", 1, "200001", None, "L60X60X5", "A1", None, "4"), ("s", 2, '"', None, None, "A2", None, "4"), ("s", 3, None, None, None, None, None, None), ("s", 4, None, None, None, "A3", None, "1")]
    got = {r["pos"]: (r["of_eff"], r["perfil_eff"], r["of_from"]) for r in linkage.carry_down(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {1: ("200001", "L60X60X5", 1), 2: ("200001", "L60X60X5", 1), 3: (None, None, None), 4: (None, None, None)}


def test_winner_shares_order_and_model(spark):
    plan = [(f"{o}:{m}", f"OF20000{o}", "OV1", "L60X60X5", f"AT{m}") for o in range(1, 4) for m in range(1, 4)]
    rows = [("s", 1, "2OOOO2", None, None, "AT3", None, "1"), ("s", 2, None, None, None, "AT1", None, "1"), ("t", 1, None, None, None, "nothing", None, "1")]
    got = {(r["sheet_uid"], r["pos"]): r["plan_key"] for r in linkage.link(spark.createDataFrame(rows, ROWS), spark.createDataFrame(plan, PLAN)).collect()}
    assert got == {("s", 1): "2:3", ("s", 2): "2:1"}


def test_empty_tables(spark):
    assert linkage.link(spark.createDataFrame([], ROWS), spark.createDataFrame([], PLAN)).count() == 0

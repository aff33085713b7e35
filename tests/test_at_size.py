"""How much the operators form on the way to their rows: no more than follows from what is asked."""

import re

from pyspark.sql import functions as F

from tallyweave import catalog
from tallyweave.functions import normalize
from tallyweave.operators import balances, decisions, dims, linkage, ranking
from tallyweave.plans import transfer
from tallyweave.sources.tables import VIEWS, Tables, with_views
from tests.test_queries import DIR


def joins(df):
    return re.findall(r"^[ :+|-]*Join .*$", df._jdf.queryExecution().optimizedPlan().toString(), re.M)


def codes(spark, n):
    rows = spark.createDataFrame([("s", i, f"{i % 40:06}", f"AT1T{i % 3}") for i in range(n)], "sheet_uid string, pos long, of_written string, modelo_written string")
    plan = spark.createDataFrame([(f"k{i}", f"OF{i % 40:06}", f"AT1T{i % 3}") for i in range(n)], "plan_key string, of_code string, modelo string")
    return rows, plan


SETS = (("of_written", "of_code"), ("modelo_written", "modelo"))


def test_intersection_joins_on_all_keys(spark):
    rows, plan = codes(spark, 300)
    found = linkage.exact_in_all(rows, plan, SETS)
    assert sorted(map(tuple, found.collect())) == sorted(("s", i, f"k{j}") for i in range(300) for j in range(300) if i % 120 == j % 120)
    u2 = joins(catalog.queries()["u2_intersection_of_sets"](spark, DIR))
    assert u2 and not any("LeftSemi" in j for j in u2)


def test_union_gathers_no_pairs(spark):
    rows, plan = codes(spark, 150)
    found = linkage.exact_in_any(rows, plan.unionByName(plan), SETS)
    assert sorted(map(tuple, found.collect())) == sorted(("s", i, f"k{j}") for i in range(150) for j in range(150) if i % 40 == j % 40 or i % 3 == j % 3)
    plan_of_u1 = catalog.queries()["u1_union_of_sets"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan_of_u1 and "Union" in plan_of_u1


def test_similar_values_do_not_pass_the_driver(spark, monkeypatch):
    """Only the lengths that values have are sent to all."""
    seen, write = [], linkage.settled
    monkeypatch.setattr(linkage, "settled", lambda df: (seen.append(df), write(df))[1])
    known = write(spark.range(3000).select(F.concat(F.lit("AT1T"), c_text()).alias("v")))
    written = write(spark.range(0, 3000, 7).select(F.concat(F.lit("AT1T"), c_text()).alias("w")))
    seen.append(linkage.fuzzy_top(written, known))
    for df in seen:
        for sent in re.findall(r"BroadcastExchange.*?\n(.*?)\n", df._jdf.queryExecution().executedPlan().toString()):
            assert "explode" not in sent.lower() and not re.search(r"\b[wv]#", sent), sent


def c_text():
    return F.lpad(F.col("id").cast("string"), 6, "0")


def test_dimensions_stop_at_their_cap(spark, monkeypatch):
    formed, within = [], dims.within
    monkeypatch.setattr(dims, "within", lambda *a: (formed.append(within(*a)), formed[-1])[1])
    rows = spark.range(30).select("id", F.lit(1.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    rows = rows.unionByName(rows.where("id = 4"))
    lines = spark.range(20000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    found = dims.candidates(rows, lines, "id", "k", {"a": 1.0, "b": 1.0}, 10).collect()
    near = {b: [k for k in range(0, 20000, 2) if abs(k % 5 - b) <= 1][:10] for b in range(3)}
    doubled = sorted(near[1] * 2)[:10]
    assert sorted(map(tuple, found)) == sorted((i, k) for i in range(30) for k in (doubled if i == 4 else near[i % 3]))
    assert sum(f.count() for f in formed) < 5000


def test_pool_needs_no_join_of_pairs(spark):
    """The same rows as the statement that other engines run, which Spark would answer with a join."""
    t = Tables(spark, DIR)
    assert len(joins(t.pool)) == 3
    base = {x: t.base(x) for x in ("lineitem", "orders", "customer", "part")}
    sql = with_views("SELECT * FROM pool", VIEWS)
    for x in base:
        sql = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", sql)
    expected = spark.sql(sql, **base)
    assert expected.columns == t.pool.columns and expected.count() == t.pool.count()
    assert expected.exceptAll(t.pool).isEmpty()


def test_support_and_brier_read_the_pool_once(spark):
    t = Tables(spark, DIR)
    for df in (ranking.support_by_value(t.pool), ranking.posterior_by_temperature(t.pool, t.spark.range(1).select(F.lit(9).alias("n")))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LATERAL VIEW") + df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(lines") == 1


def test_rows_meet_their_lines_once(spark):
    """One join with the plan for all fields, and one look-up a field for rows without a line."""
    rows = spark.createDataFrame([("s", 1, "k1", "x", "200001", None, "L40X40X3", "AT1T1"), ("s", 2, None, None, "200002", "1", None, "AT1T9"), ("s", 3, "gone", None, "7", None, None, "A")], "sheet_uid string, pos long, plan_key string, perf_comp string, of_eff string, ov_eff string, perfil_eff string, modelo_written string")
    plan = spark.createDataFrame([("k1", "OF200001", "OV0000001", "L40X40X3", "AT1T7")], "plan_key string, of_code string, ov string, perfil string, modelo string")
    known = {n: plan.select(linkage.field_key(n, F.col(f)).alias("k")) for n, _, f in decisions.FIELDS}
    found = decisions.cell_status(rows, plan, known)
    got = {(r["pos"], r["field"]): r["status"] for r in found.collect()}
    assert got == {(1, "of"): "confirmed", (1, "ov"): "snapped", (1, "perfil"): "confirmed", (1, "modelo"): "snapped", (2, "of"): "unmatched", (2, "ov"): "unmatched", (2, "perfil"): "na", (2, "modelo"): "unmatched", (3, "of"): "na", (3, "ov"): "na", (3, "perfil"): "na", (3, "modelo"): "na"}
    assert len(joins(found)) == 5


def test_history_counts_no_distinct_observations(spark):
    """Lines are made once for both sides, and each side is one aggregate of plain values."""
    plan = catalog.queries()["j19_history_join"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and "l_orderkey" not in plan


def test_usual_forms_need_no_parser(spark):
    """Codes and angles as they mostly are have the same keys as the longer way gives them."""
    texts = ["L40X40X3", "l40 x 40X3", "40 x 40 x 3", "L040X40X3", "L40X40X3\n", "LL4X4X4", "4X4", "", None, "12_AB", "OF2", "É1", "0x1x2"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    long = [normalize.parse_profile(F.col("s"))["key"], normalize._compacted(F.col("s"))]
    for x, y in df.select(F.struct(normalize.profile_key(F.col("s")), normalize.compact(F.col("s"))), F.struct(*long)).collect():
        assert tuple(x) == tuple(y)
    assert df.where(F.col("s").rlike(normalize.IS_ANGLE)).count() == 1 and df.where(F.col("s").rlike(normalize.LIKE_ANGLE)).count() == 3


def test_days_meet_no_list_of_loads(spark):
    """A day asked for looks one load back and one ahead; orders and profiles are joined with nothing."""
    history = spark.range(40).selectExpr("'o' AS of_code", "'L4X4X4' AS perfil", "concat('m', id) AS snapshot_id", "timestamp'2020-01-01 06:00:00' + make_dt_interval(cast(id * 2 as int)) AS loaded_at", "'A' AS modelo", "1.0D AS comp_mm", "true AS falta_valida", "cast(id as double) AS qtd_restante")
    asked = spark.range(80).selectExpr("'o' AS of", "'L4X4X4' AS perfil", "date_add(date'2019-12-30', cast(id as int)) AS day")
    before = asked.selectExpr("day", "CASE WHEN day > date'2020-01-01' THEN concat('m', cast(floor((datediff(day, date'2020-01-01') - 1) / 2) as int)) END AS snapshot_id").selectExpr("day", "CASE WHEN snapshot_id NOT IN ('m3', 'm40') THEN snapshot_id WHEN snapshot_id = 'm3' THEN 'other' ELSE snapshot_id END AS snapshot_id")
    found = balances.balance_cascade(asked, before, history)
    assert len(joins(found)) == 1
    for r in found.join(before.withColumnRenamed("snapshot_id", "last"), "day").collect():
        day = (r["day"] - __import__("datetime").date(2020, 1, 1)).days
        held = r["last"] is not None and r["last"] in {f"m{i}" for i in range(40)}
        later = [i for i in range(40) if i * 2 >= day]
        expected = (r["last"], False) if held else (f"m{later[0]}", True) if later else (None, None)
        assert (r["snapshot_id"], r["approximate"]) == expected


def test_orders_are_summed_before_rows_meet_them(spark):
    """Rows meet one row an order, once, not its lines for each source."""
    assert len(joins(catalog.queries()["j25_recover_refs"](spark, DIR))) == 7


def test_stream_of_sheets_has_many_parts(spark, monkeypatch):
    seen, stream = [], transfer.jobs.table_stream
    monkeypatch.setattr(transfer.jobs, "table_stream", lambda s, path, files=1: (seen.append((path, files)), stream(s, path, files))[1])
    catalog.queries()["st4_stream_match"](spark, DIR)
    path, files = seen[-1]
    assert (files, len(spark.read.parquet(path).inputFiles())) == (3, 9)


def test_refs_are_made_once(spark):
    plan = catalog.queries()["s14_write_plan_refs"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Window" not in plan

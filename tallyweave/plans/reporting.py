"""Queries of aggregates, as-of lookups, sets, expansion and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.operators import linkage as L
from tallyweave.operators import reports as R

from .linking import _PK, _REST, CARRY, OKEY
from .registry import Registry

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
c = F.col


@query("a1_value_frequency", "SELECT modelo, count(*) AS n FROM plan_lines GROUP BY modelo")
def _(t):
    return t.plan.groupBy("modelo").agg(F.count(F.lit(1)).alias("n"))


@query("a2_entity_frequency", "SELECT modelo, count(DISTINCT of_code) AS n FROM plan_lines GROUP BY modelo")
def _(t):
    return t.plan.groupBy("modelo").agg(F.count_distinct("of_code").alias("n"))


@query("a3_plan_quantity", "SELECT of_code, modelo, sum(qtd_planeada) AS planned FROM plan_lines GROUP BY of_code, modelo")
def _(t):
    return t.plan.groupBy("of_code", "modelo").agg(F.sum("qtd_planeada").alias("planned"))


@query("a4_unambiguous_customer", "SELECT modelo, CASE WHEN count(DISTINCT cliente) = 1 THEN max(cliente) END AS cliente FROM plan_lines GROUP BY modelo")
def _(t):
    return R.unambiguous(t.plan, "modelo", "cliente")


@query("a5_plan_by_order", """WITH l AS (SELECT 'cantoneiras' AS family, of_code, falta_valida, qtd_restante, maquina, snapshot_id AS semana FROM plan_lines
  UNION ALL SELECT 'chapa', concat('OF', CAST(200000 + l_orderkey AS VARCHAR)), l_returnflag <> 'R', l_quantity, concat('Machine ', l_suppkey % 9), concat('w', CAST(year(l_shipdate) AS VARCHAR)) FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT family, of_code, CASE WHEN bool_and(falta_valida) THEN sum(qtd_restante) END AS remaining, string_agg(DISTINCT maquina, ', ' ORDER BY maquina) AS machines, min(semana) AS first_week FROM l GROUP BY family, of_code""")
def _(t):
    first = t.plan.select(F.lit("cantoneiras").alias("family"), "of_code", "falta_valida", "qtd_restante", "maquina", c("snapshot_id").alias("semana"))
    items = t.base("lineitem").where("l_linenumber % 2 = 0")
    second = items.select(F.lit("chapa").alias("family"), F.concat(F.lit("OF"), (200000 + c("l_orderkey")).cast("string")).alias("of_code"), (c("l_returnflag") != "R").alias("falta_valida"), c("l_quantity").alias("qtd_restante"), F.concat(F.lit("Machine "), (c("l_suppkey") % 9).cast("string")).alias("maquina"), F.concat(F.lit("w"), F.year("l_shipdate").cast("string")).alias("semana"))
    return R.plan_by_order(first.unionByName(second))


@query("a6_validated_by_order", "SELECT of_code, sum(qtd) AS made, max(sheet_date) AS last_day, count(*) AS n FROM facts GROUP BY of_code")
def _(t):
    return t.facts.groupBy("of_code").agg(F.sum("qtd").alias("made"), F.max("sheet_date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("a8_profiles_in_order", "WITH g AS (SELECT of_code, trim(perfil) AS perfil, count(*) AS n FROM plan_lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY of_code ORDER BY n DESC, perfil) AS rank FROM g) SELECT * FROM r WHERE rank <= 40")
def _(t):
    g = t.plan.groupBy("of_code", F.trim("perfil").alias("perfil")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("of_code").orderBy(c("n").desc(), "perfil"))).where("rank <= 40")


@query("a9_balance_totals", """WITH k AS (SELECT *, CASE WHEN falta_valida THEN qtd_restante END AS known FROM plan_lines)
SELECT of_code, sum(known) AS remaining, count(known) > 0 AND count(known) < count(*) AS partial,
  CASE WHEN NOT bool_or(coalesce(known > 0 AND comp_mm IS NULL, false)) THEN round(coalesce(sum(CASE WHEN known > 0 THEN known * comp_mm / 1000 END), 0), 3) END AS metres FROM k GROUP BY of_code""")
def _(t):
    return R.balance_totals(t.plan, "of_code")


@query("a13_edit_count", "SELECT sheet_uid, count(*) AS n, count(DISTINCT field_path) AS fields FROM edits WHERE source = 'human' AND old_value IS DISTINCT FROM new_value GROUP BY sheet_uid")
def _(t):
    changed = t.edits.where((c("source") == "human") & ~c("old_value").eqNullSafe(c("new_value")))
    return changed.groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("field_path").alias("fields"))


@query("a16_active_orders", "SELECT DISTINCT of_code FROM facts WHERE sheet_date > DATE '1999-06-30' - INTERVAL 14 DAY AND sheet_date <= DATE '1999-06-30'")
def _(t):
    return R.active_orders(t.facts, F.lit("1999-06-30").cast("date"))


@query("s2_latest_snapshot", "SELECT dataset_id, arg_max(snapshot_id, loaded_at) AS snapshot_id, max(loaded_at) AS loaded_at FROM snapshots WHERE starts_with(snapshot_id, 'm1997') GROUP BY dataset_id UNION ALL SELECT dataset_id, arg_max(snapshot_id, loaded_at), max(loaded_at) FROM snapshots GROUP BY dataset_id HAVING dataset_id = 'plan'")
def _(t):
    return R.latest_snapshot(t.snapshots, prefix="m1997").unionByName(R.latest_snapshot(t.snapshots, "plan"))


@query("s15_read_archive", "SELECT f.sheet_uid, l_orderkey, row_index, sheet_date, operador, CAST(substr(f.sheet_uid, 3) AS BIGINT) AS sheet_no FROM facts f WHERE sheet_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' AND operador = 'Operator 3' AND CAST(substr(f.sheet_uid, 3) AS BIGINT) % 7 > 0")
def _(t):
    n = F.substr("sheet_uid", F.lit(3)).cast("long")
    facts = t.facts.withColumn("sheet_no", n).withColumn("template_name", F.when(n % 7 == 0, "paragens").otherwise("cantoneiras_kanban"))
    return R.read_archive(facts, "1995-01-01", "1996-06-30", "Operator 3").select("sheet_uid", "l_orderkey", "row_index", "sheet_date", "operador", "sheet_no")


@query("s21_neutralize_formula", "WITH v AS (SELECT plan_key, concat(substr('=+-@ ab', CAST(comp_mm AS BIGINT) // 50 % 7 + 1, 1), modelo) AS v FROM plan_lines) SELECT plan_key, CASE WHEN regexp_matches(v, '^[=+@-]') THEN concat('''', v) ELSE v END AS v FROM v")
def _(t):
    mark = F.expr("substr('=+-@ ab', cast(cast(comp_mm as bigint) div 50 % 7 + 1 as int), 1)")
    first = F.coalesce(mark, F.lit(""))  # concat of the other engine leaves nulls out
    return t.plan.select("plan_key", N.neutralize_formula(F.concat(first, "modelo")).alias("v"))


@query("j22_plan_vs_validated", """WITH p AS (SELECT of_code, sum(qtd_planeada) AS planned FROM plan_lines GROUP BY of_code), f AS (SELECT of_code, sum(qtd) AS made, count(*) AS facts, max(sheet_date) AS last_day FROM facts GROUP BY of_code)
SELECT coalesce(p.of_code, f.of_code) AS of_code, planned, made, facts, last_day, p.of_code IS NULL AS without_plan FROM p FULL JOIN f ON p.of_code = f.of_code""")
def _(t):
    return R.plan_against_facts(t.plan, t.facts)


@query("x1_expand_full_profile", f"""WITH {CARRY}, j AS (SELECT sheet_uid, pos, plan_key, p.qtd_restante, bool_and(coalesce(p.falta_valida AND p.qtd_restante >= 0, false)) OVER (PARTITION BY sheet_uid, pos) AS sound
  FROM carried JOIN plan_lines p ON {OKEY('of_eff')} = {OKEY('of_code')} AND {_PK(_REST)} = p.perfil WHERE perf_comp = 'x') SELECT sheet_uid, pos, plan_key, CASE WHEN sound THEN qtd_restante END AS assumed FROM j""")
def _(t):
    return R.expand_full_profile(L.carry_down(t.rows), t.plan)


@query("x4_line_meters", "SELECT plan_key, row_index, round(qtd * comp_mm / 1000, 3) AS metres FROM facts")
def _(t):
    return t.facts.select("plan_key", "row_index", R.line_metres(c("qtd"), c("comp_mm")).alias("metres"))


@query("u3_difference", "SELECT plan_key FROM plan_lines EXCEPT SELECT plan_key FROM facts WHERE qtd IS NOT NULL")
def _(t):
    return t.plan.select("plan_key").subtract(t.facts.where("qtd is not null").select("plan_key"))


@query("u4_dedup_first", "WITH r AS (SELECT plan_key, row_index, sheet_date, row_number() OVER (PARTITION BY plan_key ORDER BY row_index, sheet_date) AS k FROM facts) SELECT plan_key, row_index, sheet_date FROM r WHERE k = 1")
def _(t):
    first = F.min(F.struct("row_index", "sheet_date")).alias("f")
    return t.facts.groupBy("plan_key").agg(first).select("plan_key", "f.row_index", "f.sheet_date")

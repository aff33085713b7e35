"""Queries of audit folds, lists, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.operators import audit as A
from tallyweave.operators import decisions as D
from tallyweave.operators import linkage as L
from tallyweave.operators import reports as R
from tallyweave.operators.lineage import settled

from .decisions import LINKED, N_OF, _ACCOUNTS, _cell, accounts, linked, sheet_no
from .linking import OKEY, matched_of
from .registry import Registry

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
c = F.col
KEY = ("sheet_uid", "pos")
_PATH = "'^rows\\[(\\d+)\\]\\.([a-z_]+)$'"
#: First readings: four cells of each row, under the row's place on the paper.
RAW = "raw AS (SELECT sheet_uid, pos - 1 AS \"row\", unnest(['of', 'perfil', 'modelo', 'qtd']) AS field, unnest([of_written, perfil_written, modelo_written, qtd_written]) AS value FROM sheet_rows)"


def raw_cells(t):
    cells = F.array(*(F.struct(F.lit(f).alias("field"), c(f"{f}_written").alias("value")) for f in ("of", "perfil", "modelo", "qtd")))
    return t.rows.select("sheet_uid", (c("pos") - 1).alias("row"), F.explode(cells).alias("x")).select("sheet_uid", "row", "x.*")


@query("a7_mes_kpis", "SELECT (SELECT count(*) FROM all_sheets WHERE status = 'validated') AS sheets, (SELECT count(*) FROM facts f SEMI JOIN (SELECT sheet_uid FROM all_sheets WHERE status = 'validated') s ON s.sheet_uid = f.sheet_uid) AS records")
def _(t):
    done = t.sheets.where("status = 'validated'").select("sheet_uid")
    return done.agg(F.count(F.lit(1)).alias("sheets")).crossJoin(t.facts.join(done, "sheet_uid", "left_semi").agg(F.count(F.lit(1)).alias("records")))  # one row each


@query("a10_sheet_summary", f"""WITH {LINKED}, cells AS ({" UNION ALL ".join(_cell(*f) for f in D.FIELDS)}), m AS (SELECT sheet_uid, round(sum(round(qtd * comp_mm / 1000, 3)), 2) AS planned, count(qtd * comp_mm) < count(*) AS partial FROM facts GROUP BY sheet_uid),
a AS (SELECT sheet_uid, count(*) AS rows, count_if(mode = 'strong') AS strong, count_if(mode = 'weak') AS weak FROM matched GROUP BY sheet_uid), b AS (SELECT sheet_uid, count_if(status = 'confirmed') AS confirmed, count_if(status = 'snapped') AS snapped, count_if(status = 'very_different') AS very_different FROM cells GROUP BY sheet_uid)
SELECT a.*, b.* EXCLUDE (sheet_uid), m.planned, m.partial, h.measured, CASE WHEN NOT m.partial THEN round(h.measured - m.planned, 2) END AS waste FROM a LEFT JOIN b ON b.sheet_uid = a.sheet_uid LEFT JOIN m ON m.sheet_uid = a.sheet_uid LEFT JOIN (SELECT sheet_uid, CAST({N_OF} % 50 AS DOUBLE) * 10 AS measured FROM headers) h ON h.sheet_uid = a.sheet_uid""")
def _(t):
    """The match, the plan and the linked rows are written once and used several times."""
    plan, matched = settled(t.plan.select("plan_key", *(f for _, _, f in D.FIELDS))), settled(matched_of(t))
    known = {n: plan.select(L.field_key(n, c(f)).alias("k")) for n, _, f in D.FIELDS}
    metres = t.facts.select("sheet_uid", R.line_metres(c("qtd"), c("comp_mm")).alias("metres"))
    footer = t.headers.select("sheet_uid", ((sheet_no() % 50).cast("double") * 10).alias("measured"))
    return A.sheet_summary(matched, D.cell_status(settled(linked(t, matched).select(*KEY, "plan_key", "perf_comp", *(e for _, e, _ in D.FIELDS))), plan, known), metres, footer)


@query("a13_human_fields", f"SELECT sheet_uid, CAST(regexp_extract(field_path, {_PATH}, 1) AS BIGINT) AS \"row\", string_agg(DISTINCT regexp_extract(field_path, {_PATH}, 2), ',' ORDER BY regexp_extract(field_path, {_PATH}, 2)) AS fields FROM edits WHERE source = 'human' AND old_value IS DISTINCT FROM new_value GROUP BY ALL UNION ALL SELECT sheet_uid, NULL, 'data,turno' FROM (SELECT DISTINCT sheet_uid FROM edits WHERE id % 50 = 0 AND source = 'human') a SEMI JOIN (SELECT sheet_uid FROM edits WHERE id % 70 = 0 AND source = 'human') b ON a.sheet_uid = b.sheet_uid UNION ALL SELECT sheet_uid, NULL, 'data' FROM (SELECT DISTINCT sheet_uid FROM edits WHERE id % 50 = 0 AND source = 'human') a ANTI JOIN (SELECT sheet_uid FROM edits WHERE id % 70 = 0 AND source = 'human') b ON a.sheet_uid = b.sheet_uid UNION ALL SELECT sheet_uid, NULL, 'turno' FROM (SELECT DISTINCT sheet_uid FROM edits WHERE id % 70 = 0 AND source = 'human') a ANTI JOIN (SELECT sheet_uid FROM edits WHERE id % 50 = 0 AND source = 'human') b ON a.sheet_uid = b.sheet_uid")
def _(t):
    header = t.edits.where("id % 50 = 0").withColumn("field_path", F.lit("header.data")).unionByName(t.edits.where("id % 70 = 0").withColumn("field_path", F.lit("header.turno")))
    return A.human_fields(t.edits.unionByName(header))


@query("a14_sync_summary", "SELECT count_if(sync_state IN ('pending', 'retry')) AS pending, count_if(sync_state = 'error') AS errors, min(CASE WHEN sync_state IN ('pending', 'retry', 'error') THEN validated_on END) AS oldest FROM all_sheets WHERE status = 'validated'")
def _(t):
    return A.sync_summary(t.sheets)


@query("a15_filter_options", "SELECT DISTINCT 'operador' AS field, operador AS value FROM all_sheets WHERE operador IS NOT NULL UNION ALL SELECT DISTINCT 'setor_maquina', setor_maquina FROM all_sheets WHERE setor_maquina IS NOT NULL")
def _(t):
    """From the sheets' documents as JSON: the fields are read out of the text."""
    doc = t.sheets.select(F.to_json(F.struct(F.struct("operador", "setor_maquina").alias("header"))).alias("doc"))
    one = lambda f: doc.select(F.lit(f).alias("field"), F.get_json_object("doc", f"$.header.{f}").alias("value")).where("value is not null").distinct()
    return one("operador").unionByName(one("setor_maquina"))


@query("a17_source_freshness", "WITH s AS (SELECT * FROM (VALUES ('plan'), ('staff'), ('events')) v(source)), l AS (SELECT dataset_id AS source, loaded_at FROM snapshots UNION ALL SELECT 'events', ts FROM events), m AS (SELECT source, max(loaded_at) AS latest FROM l WHERE loaded_at <= TIMESTAMP '2024-02-02 00:00:00' GROUP BY source) SELECT s.source, round(greatest(0.0, date_diff('second', latest, TIMESTAMP '2024-02-02 00:00:00') / 3600.0::DOUBLE), 6) AS hours, CASE WHEN latest IS NULL THEN 'absent' WHEN date_diff('second', latest, TIMESTAMP '2024-02-02 00:00:00') > 72 * 3600 THEN 'crit' WHEN date_diff('second', latest, TIMESTAMP '2024-02-02 00:00:00') > 36 * 3600 THEN 'warn' ELSE 'ok' END AS state FROM s LEFT JOIN m ON m.source = s.source")
def _(t):
    loads = t.snapshots.select("dataset_id", "loaded_at").unionByName(t.base("events").select(F.lit("events").alias("dataset_id"), c("ts").cast("timestamp").alias("loaded_at")))
    expected = t.spark.range(1).select(F.explode(F.array(*map(F.lit, ("plan", "staff", "events")))).alias("source"))
    return A.freshness(loads, expected, F.lit("2024-02-02 00:00:00").cast("timestamp"))


@query("a24_recovery_inventory", f"""WITH {_ACCOUNTS} SELECT s.sheet_uid, array_to_string(list_filter([CASE WHEN coalesce(trim(operador), '') = '' THEN 'operador' END, CASE WHEN coalesce(trim(n_operador), '') = '' THEN 'n_operador' END, CASE WHEN coalesce(trim(setor_maquina), '') = '' THEN 'setor_maquina' END, CASE WHEN coalesce(trim(data), '') = '' THEN 'data' END, CASE WHEN coalesce(trim(turno), '') = '' THEN 'turno' END], lambda x: x IS NOT NULL), ',') AS missing_fields,
  a.unknown AS unknown_rows, CASE WHEN a.unknown IS NOT NULL THEN CASE WHEN a.unknown = 0 THEN 'complete' ELSE 'reviewed' END END AS coverage, EXISTS (SELECT 1 FROM sheet_rows r WHERE r.sheet_uid = s.sheet_uid AND r.perf_comp = 'x') AS refresh FROM all_sheets s LEFT JOIN accounts a ON a.sheet_uid = s.sheet_uid WHERE status IN ('extracted', 'in_review')""")
def _(t):
    acc = accounts(t)
    seen = acc.withColumn("expected", c("least")).withColumn("confirmed", F.lit(None).cast("long")).withColumn("context_now", F.lit("a")).withColumn("context_then", F.lit("a"))
    return A.recovery_inventory(t.sheets, acc, D.coverage_status(seen), t.rows.where(N.is_marked(c("perf_comp"))))


@query("j13_order_lines", "SELECT plan_key, perfil, qtd_restante FROM plan_lines WHERE of_code = 'OF200033' AND upper(trim(perfil)) LIKE 'L%'")
def _(t):
    return A.order_lines(t.plan, "of200033", "l").select("plan_key", "perfil", "qtd_restante")


@query("k1_order_lines", "WITH r AS (SELECT plan_key, of_code, qtd_restante, row_number() OVER (PARTITION BY of_code ORDER BY NOT falta_valida, qtd_restante DESC NULLS LAST, modelo, plan_key) AS place FROM plan_lines) SELECT * FROM r")
def _(t):
    """Valid lines first, most remaining first, unknown last; in each order."""
    order = Window.partitionBy("of_code").orderBy((~c("falta_valida")), c("qtd_restante").desc_nulls_last(), "modelo", "plan_key")
    return t.plan.select("plan_key", "of_code", "qtd_restante", F.row_number().over(order).alias("place"))


@query("j14_lookup_cascade", "SELECT 'ov' AS mode, plan_key FROM (SELECT * FROM plan_lines WHERE ov = 'OV0000007' AND (qtd_restante > 0 OR NOT falta_valida) ORDER BY qtd_restante NULLS LAST, of_code, perfil, modelo, plan_key LIMIT 50) UNION ALL SELECT 'of', plan_key FROM (SELECT * FROM plan_lines WHERE of_code = 'OF200033' ORDER BY qtd_restante NULLS LAST, of_code, perfil, modelo, plan_key LIMIT 50) UNION ALL SELECT 'modelo', plan_key FROM (SELECT * FROM plan_lines WHERE modelo LIKE 'AT1T1%' AND (qtd_restante > 0 OR NOT falta_valida) ORDER BY qtd_restante NULLS LAST, of_code, perfil, modelo, plan_key LIMIT 50)")
def _(t):
    """Three searches: a sales order, an order with its lines that are done, and a model's beginning."""
    found = [A.lookup(t.plan, "0000007"), A.lookup(t.plan, "of200033", done=True), A.lookup(t.plan, "at1t1")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("mode", "plan_key")


@query("k2_page", "SELECT plan_key, true AS has_more FROM (SELECT plan_key FROM plan_lines ORDER BY qtd_restante NULLS LAST, plan_key LIMIT 50 OFFSET 100)")
def _(t):
    return A.page(t.plan.select("plan_key", "qtd_restante"), [c("qtd_restante").asc_nulls_last(), c("plan_key")], 100, 50).select("plan_key", "has_more")


@query("k2_page_by_key", "SELECT of_code, plan_key FROM plan_lines WHERE (of_code, plan_key) > ('OF200500', '500:9') ORDER BY of_code, plan_key LIMIT 50")
def _(t):
    return A.after_key(t.plan.select("of_code", "plan_key"), ["of_code", "plan_key"], ("OF200500", "500:9"), 50)


@query("k3_history_list", "SELECT 'pending' AS asked, sheet_uid FROM all_sheets WHERE status NOT IN ('validated', 'error') UNION ALL SELECT 'avisos', sheet_uid FROM all_sheets WHERE status = 'validated' AND n_warnings > 0 UNION ALL SELECT 'a_gravar', sheet_uid FROM all_sheets WHERE status = 'validated' AND sync_state IN ('pending', 'retry', 'error') UNION ALL SELECT 'error', sheet_uid FROM all_sheets WHERE status = 'error' AND setor_maquina = 'Machine 4'")
def _(t):
    asked = [A.list_sheets(t.sheets, s).select(F.lit(s).alias("asked"), "sheet_uid") for s in ("pending", "avisos", "a_gravar")]
    asked.append(A.list_sheets(t.sheets, "error", setor="Machine 4").select(F.lit("error").alias("asked"), "sheet_uid"))
    out = asked[0]
    for x in asked[1:]:
        out = out.unionByName(x)
    return out


@query("k4_export_order", "SELECT sheet_uid, l_orderkey, row_index, plan_key, coalesce(CAST(sheet_date AS VARCHAR), '9999') AS day, row_number() OVER (PARTITION BY sheet_uid ORDER BY coalesce(CAST(CASE WHEN row_index % 3 > 0 THEN sheet_date END AS VARCHAR), '9999'), operador, l_orderkey, row_index, plan_key, sheet_date) AS place FROM facts")
def _(t):
    """The place of each fact in its sheet's export; every third row has no date and goes last."""
    day = F.coalesce(F.when(c("row_index") % 3 > 0, c("sheet_date")).cast("string"), F.lit("9999"))
    order = Window.partitionBy("sheet_uid").orderBy(day, "operador", "l_orderkey", "row_index", "plan_key", "sheet_date")
    return t.facts.select("sheet_uid", "l_orderkey", "row_index", "plan_key", F.coalesce(c("sheet_date").cast("string"), F.lit("9999")).alias("day"), F.row_number().over(order).alias("place"))


_ORDERS = "o AS (SELECT p.of_code, max(p.cliente) AS cliente, max(p.ov) AS ov, max(f.sheet_date) AS last_day FROM plan_lines p LEFT JOIN facts f ON f.plan_key = p.plan_key GROUP BY p.of_code)"


def orders_shown(t):
    f = t.facts.groupBy("plan_key").agg(F.max("sheet_date").alias("d"))
    return t.plan.join(f, "plan_key", "left").groupBy("of_code").agg(F.max("cliente").alias("cliente"), F.max("ov").alias("ov"), F.max("d").alias("last_day"))


@query("k5_recent_first", f"WITH {_ORDERS} SELECT of_code, last_day FROM o ORDER BY last_day IS NULL, last_day DESC, coalesce(cliente, '~'), of_code")
def _(t):
    return A.recent_first(orders_shown(t)).select("of_code", "last_day")


@query("k6_filter_rows", f"WITH {_ORDERS} SELECT of_code FROM o WHERE contains(lower(cliente), '0012') OR contains(lower(ov), '0012') OR contains(lower(of_code), '0012')")
def _(t):
    return A.contains_search(orders_shown(t), " 0012 ", ("cliente", "ov", "of_code")).select("of_code")


_SETS = (("of_written", "of_code"), ("modelo_written", "modelo"))


@query("u1_union_of_sets", f"SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN plan_lines ON {OKEY('of_written')} = {OKEY('of_code')} UNION SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN plan_lines ON {OKEY('modelo_written')} = {OKEY('modelo')}")
def _(t):
    return L.exact_in_any(t.rows, t.plan, _SETS)


@query("u2_intersection_of_sets", f"SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN plan_lines ON {OKEY('of_written')} = {OKEY('of_code')} INTERSECT SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN plan_lines ON {OKEY('modelo_written')} = {OKEY('modelo')}")
def _(t):
    return L.exact_in_all(t.rows, t.plan, _SETS)


_FLOORED = "ev AS (SELECT e.* FROM edits e JOIN all_sheets s ON s.sheet_uid = e.sheet_uid WHERE e.id > s.event_floor)"


@query("g1_build_evidence", f"""WITH {RAW}, {_FLOORED}, h AS (SELECT sheet_uid, CAST(regexp_extract(field_path, {_PATH}, 1) AS BIGINT) AS "row", regexp_extract(field_path, {_PATH}, 2) AS field, arg_max(coalesce(new_value, ''), id) AS written FROM ev WHERE source = 'human' GROUP BY ALL),
k AS (SELECT h.* FROM h SEMI JOIN raw ON raw.sheet_uid = h.sheet_uid AND raw."row" = h."row")
SELECT coalesce(raw.sheet_uid, k.sheet_uid) AS sheet_uid, coalesce(raw."row", k."row") AS "row", coalesce(raw.field, k.field) AS field, CASE WHEN k.field IS NOT NULL THEN nullif(k.written, '') ELSE raw.value END AS value, CASE WHEN k.field IS NOT NULL THEN 'human' ELSE 'first_reading' END AS source
FROM raw FULL JOIN k ON k.sheet_uid = raw.sheet_uid AND k."row" = raw."row" AND k.field = raw.field ANTI JOIN (SELECT DISTINCT sheet_uid, id % 8 AS gone FROM ev WHERE id % 97 = 0 AND source = 'human') g ON g.sheet_uid = coalesce(raw.sheet_uid, k.sheet_uid) AND g.gone = coalesce(raw."row", k."row")""")
def _(t):
    """Rows that a person deletes: the eighth's remainder of every 97th event."""
    kept = A.of_generation(t.edits, t.sheets)
    gone = kept.where("id % 97 = 0").withColumn("field_path", F.concat(F.lit("rows["), (c("id") % 8).cast("string"), F.lit("]"))).withColumn("new_value", F.lit("<apagada>"))
    return A.build_evidence(raw_cells(t), kept.unionByName(gone))


@query("g1_explicit_bindings", f"""WITH b AS (SELECT DISTINCT sheet_uid, id % 8 AS "row", max(id) AS id FROM edits WHERE id % 5 = 0 GROUP BY ALL), e AS (SELECT sheet_uid, CAST(regexp_extract(field_path, {_PATH}, 1) AS BIGINT) AS "row", max(id) AS edited FROM edits WHERE source = 'human' AND regexp_extract(field_path, {_PATH}, 2) IN ('of', 'ov', 'perfil', 'modelo', 'cliente') GROUP BY ALL)
SELECT b.sheet_uid, b."row", b.id FROM b LEFT JOIN e ON e.sheet_uid = b.sheet_uid AND e."row" = b."row" WHERE edited IS NULL OR edited < b.id""")
def _(t):
    b = t.edits.where("id % 5 = 0").groupBy("sheet_uid", (c("id") % 8).alias("row")).agg(F.max("id").alias("id"))
    return A.explicit_bindings(b, t.edits)


@query("g2_generation_floor", f"WITH {_FLOORED} SELECT id, sheet_uid, field_path FROM ev WHERE source = 'human'")
def _(t):
    return A.of_generation(t.edits, t.sheets).where("source = 'human'").select("id", "sheet_uid", "field_path")


@query("g3_revert_system_edits", """WITH w AS (SELECT sheet_uid, field_path, max(id) AS id, arg_max(coalesce(old_value, '~'), id) AS o, arg_max(new_value, id) AS v FROM edits WHERE source = 'system' AND old_value IS DISTINCT FROM new_value GROUP BY ALL), h AS (SELECT sheet_uid, field_path, max(id) AS h FROM edits WHERE source = 'human' GROUP BY ALL),
n AS (SELECT sheet_uid, field_path, CASE WHEN max(id) % 5 = 0 THEN 'other' ELSE arg_max(new_value, id) END AS value FROM edits GROUP BY ALL)
SELECT w.sheet_uid, w.field_path, w.v AS from_value, nullif(w.o, '~') AS to_value FROM w SEMI JOIN (SELECT sheet_uid FROM all_sheets WHERE status <> 'validated') s ON s.sheet_uid = w.sheet_uid LEFT JOIN h ON h.sheet_uid = w.sheet_uid AND h.field_path = w.field_path JOIN n ON n.sheet_uid = w.sheet_uid AND n.field_path = w.field_path WHERE (h IS NULL OR h < w.id) AND coalesce(trim(n.value), '') = coalesce(trim(w.v), '')""")
def _(t):
    now = A.last_per_cell(t.edits).select("sheet_uid", "field_path", F.when(c("id") % 5 == 0, "other").otherwise(c("new_value")).alias("value"))
    return A.reverts(t.edits, now, t.sheets.where("status <> 'validated'"))


@query("g4_doc_diff", """WITH a AS (SELECT sheet_uid, field_path, arg_min(coalesce(new_value, '~'), id) AS v FROM edits WHERE id % 3 > 0 GROUP BY ALL), b AS (SELECT sheet_uid, field_path, arg_max(coalesce(new_value, '~'), id) AS v FROM edits WHERE id % 4 > 0 GROUP BY ALL)
SELECT coalesce(a.sheet_uid, b.sheet_uid) AS sheet_uid, coalesce(a.field_path, b.field_path) AS field_path, nullif(a.v, '~') AS before, nullif(b.v, '~') AS after FROM a FULL JOIN b ON a.sheet_uid = b.sheet_uid AND a.field_path = b.field_path WHERE nullif(a.v, '~') IS DISTINCT FROM nullif(b.v, '~')""")
def _(t):
    first = t.edits.where("id % 3 > 0").groupBy("sheet_uid", "field_path").agg(F.min(F.struct("id", "new_value")).alias("x")).select("sheet_uid", "field_path", c("x.new_value").alias("value"))
    return A.doc_diff(first, A.last_per_cell(t.edits.where("id % 4 > 0")).select("sheet_uid", "field_path", c("new_value").alias("value")))


@query("g5_recalc_report", f"""WITH n AS (SELECT sheet_uid, count(*) AS filled, count_if(pos % 5 > 0) AS production FROM sheet_rows GROUP BY sheet_uid)
SELECT s.sheet_uid, CASE WHEN status = 'validated' THEN 'validated_immutable' WHEN status = 'pending' THEN 'ocr_pending' WHEN template_name <> 'cantoneiras_kanban' THEN 'not_a_production_template' WHEN sheet_no % 11 = 0 THEN 'no_original_transcription' WHEN coalesce(filled, 0) = 0 THEN 'empty_original_rows' WHEN production = 0 THEN 'no_eligible_production' END AS reason FROM all_sheets s LEFT JOIN n ON n.sheet_uid = s.sheet_uid""")
def _(t):
    n = t.rows.groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("filled"), F.count_if(c("pos") % 5 > 0).alias("production"))
    s = t.sheets.join(n, "sheet_uid", "left")
    return s.select("sheet_uid", A.skip_reason(c("status"), c("template_name"), c("sheet_no") % 11 != 0, F.coalesce("production", F.lit(0)), F.coalesce("filled", F.lit(0))).alias("reason"))


@query("g6_preserved_fingerprint", f"SELECT DISTINCT sheet_uid FROM sheet_rows WHERE {N_OF} % 9 = 0 AND pos = 2 AND qtd_written IS NOT NULL")
def _(t):
    """After a run that wrote identities (no matter) and, in every ninth sheet, one measured quantity (caught)."""
    after = t.rows.withColumn("of_written", F.lit("1")).withColumn("qtd_written", F.when((sheet_no() % 9 == 0) & (c("pos") == 2), F.concat("qtd_written", F.lit("0"))).otherwise(c("qtd_written")))
    return A.changed_prints(A.preserved(t.rows, "pos", "qtd_written", "perf_comp"), A.preserved(after, "pos", "qtd_written", "perf_comp"))

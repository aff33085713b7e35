"""Queries of sources, sinks, exports and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import balances as B
from tallyweave.operators import linkage as L
from tallyweave.operators import reports as R
from tallyweave.operators.lineage import scratch_dir, settled
from tallyweave.sources import readers as S
from tallyweave.sources import sinks
from tallyweave.streaming import jobs

from .balances import LINES
from .decisions import N_OF, sheet_no
from .linking import CARRY, OKEY
from .registry import Registry

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
c = F.col
KEY = ("sheet_uid", "pos")
NOW = "2002-01-15 12:00:00"


@query("s1_read_plan", "SELECT * FROM plan_lines WHERE snapshot_id = 'm199701'")
def _(t):
    """Written by snapshot once, then one snapshot's files are read."""
    folder = scratch_dir(t.spark)
    t.plan.repartition("snapshot_id").write.partitionBy("snapshot_id").parquet(folder)
    return S.read_plan(t.spark.read.parquet(folder), "m199701").select(*t.plan.columns)


@query("s3_plan_age", f"SELECT snapshot_id, round(greatest(0.0, date_diff('second', loaded_at, TIMESTAMP '{NOW}') / 86400.0::DOUBLE), 6) AS days FROM snapshots UNION ALL SELECT 'unknown', 30.0")
def _(t):
    known = t.snapshots.select("snapshot_id", "loaded_at").unionByName(t.spark.range(1).select(F.lit("unknown").alias("snapshot_id"), F.lit(None).cast("timestamp").alias("loaded_at")))
    return known.select("snapshot_id", F.round(S.plan_age_days(c("loaded_at"), F.lit(NOW).cast("timestamp")), 6).alias("days"))


_BATCH = "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'chapa_' ELSE 'other_' END, CAST(year(l_shipdate) AS STRING))"
_ITEMS = f"i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, {_BATCH} AS batch_id FROM lineitem), b AS (SELECT batch_id, max(l_shipdate) AS loaded_at FROM i GROUP BY batch_id)"


def items(t):
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", F.expr(_BATCH).alias("batch_id"))


def batches(rows):
    return rows.groupBy("batch_id").agg(F.max("l_shipdate").alias("loaded_at"))


@query("s4_read_components", f"WITH {_ITEMS} SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, p_size AS esp, l_quantity AS qtd_planeada FROM i JOIN part ON p_partkey = l_partkey WHERE batch_id = (SELECT batch_id FROM b WHERE starts_with(batch_id, 'chapa') ORDER BY loaded_at DESC, batch_id DESC LIMIT 1)")
def _(t):
    rows = S.latest_batch(items(t), batches(items(t)), prefix="chapa")
    return rows.join(t.base("part"), c("p_partkey") == c("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", c("p_size").alias("esp"), c("l_quantity").alias("qtd_planeada"))


@query("s5_read_nestings", f"WITH {_ITEMS} SELECT concat('N', i.l_partkey) AS nesting, count(*) AS repeticoes, max(p_size) AS esp, max(l_shipdate) AS data_fabrico FROM i JOIN part ON p_partkey = l_partkey WHERE batch_id = (SELECT batch_id FROM b ORDER BY loaded_at DESC, batch_id DESC LIMIT 1) GROUP BY i.l_partkey")
def _(t):
    rows = S.latest_batch(items(t), batches(items(t))).join(t.base("part"), c("p_partkey") == c("l_partkey"))
    return rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("repeticoes"), F.max("p_size").alias("esp"), F.max("l_shipdate").alias("data_fabrico")).select(F.concat(F.lit("N"), "l_partkey").alias("nesting"), "repeticoes", "esp", "data_fabrico")


@query("s6_read_machines", "SELECT 'machine' AS kind, CAST(NULL AS BIGINT) AS cod, maquina AS name FROM (SELECT DISTINCT maquina FROM plan_lines WHERE snapshot_id = (SELECT max(snapshot_id) FROM plan_lines)) UNION ALL SELECT 'employee', c_custkey, c_name FROM customer")
def _(t):
    """Machines of the latest snapshot, employees, and a table that isn't there."""
    tables = {"employees": t.base("customer").select(c("c_custkey").alias("cod"), c("c_name").alias("name"))}
    last = t.plan.agg(F.max("snapshot_id").alias("snapshot_id"))
    machines = t.plan.join(F.broadcast(last), "snapshot_id").select(c("maquina").alias("name")).distinct()  # one row
    staff = S.optional_table(tables, "employees", "cod long, name string", t.spark)
    gone = S.optional_table(tables, "contractors", "cod long, name string", t.spark)
    people = staff.unionByName(gone).select(F.lit("employee").alias("kind"), "cod", "name")
    return machines.select(F.lit("machine").alias("kind"), F.lit(None).cast("long").alias("cod"), "name").unionByName(people)


def documents(t):
    """sheet_uid, json of each sheet: its rows in order, with blanks around values and an empty row at the end."""
    row = F.struct(*(F.concat(F.lit(" "), f"{f}_written").alias(f) for f in ("of", "ov", "perfil", "modelo")), c("perf_comp"), c("qtd_written").alias("qtd"), F.lit("z").alias("unknown_field"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"])
    empty = F.array(F.from_json(F.lit('{"of": "  "}'), "struct<of:string,ov:string,perfil:string,modelo:string,perf_comp:string,qtd:string,unknown_field:string>"))
    return t.rows.groupBy("sheet_uid").agg(rows.alias("rows")).select("sheet_uid", F.to_json(F.struct(F.concat("rows", empty).alias("rows"))).alias("json"))


@query("s7_parse_extractions", "SELECT sheet_uid, row_number() OVER (PARTITION BY sheet_uid ORDER BY pos) AS pos, trim(of_written) AS of, trim(ov_written) AS ov, trim(perfil_written) AS perfil, trim(modelo_written) AS modelo, trim(perf_comp) AS perf_comp, trim(qtd_written) AS qtd FROM sheet_rows WHERE coalesce(of_written, ov_written, perfil_written, modelo_written, perf_comp, qtd_written) IS NOT NULL")
def _(t):
    return S.parse_extractions(documents(t))


@query("s8_salvage_json", f"SELECT sheet_uid, CAST(count(*) - CASE WHEN {N_OF} % 20 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM sheet_rows GROUP BY sheet_uid")
def _(t):
    """Every twentieth transcript is cut inside its last row, every third has thoughts before it, every fourth fences."""
    n = sheet_no()
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("of_written", F.lit("?")).alias("of"), F.coalesce("modelo_written", F.lit("?")).alias("modelo")))), lambda x: F.struct(x["of"].alias("of"), x["modelo"].alias("modelo")))
    docs = t.rows.groupBy("sheet_uid").agg(F.to_json(F.struct(rows.alias("rows"))).alias("json"))
    cut = F.when(n % 20 == 0, F.regexp_replace("json", r'"modelo":"[^"]*"\}\]\}$', '"mod')).otherwise(c("json"))
    text = F.concat(F.when(n % 3 == 0, "<think>{rows?}\n</think>\n").otherwise(""), F.when(n % 4 == 0, "```json\n").otherwise(""), cut, F.when((n % 4 == 0) & (n % 20 != 0), "\n```\n").otherwise(""))
    return docs.select("sheet_uid", F.size(F.from_json(S.salvage_json(text), S.DOCUMENT)["rows"]).cast("long").alias("rows"))


def files(t):
    """Pages as files; every seventeenth can't be read."""
    sha = F.when(c("page_id") % 17 > 0, F.sha2(c("html").cast("binary"), 256))
    return t.base("pages").select(c("url").alias("name"), sha.alias("sha"), "page_id")


_FILES = "f AS (SELECT url AS name, CASE WHEN page_id % 17 > 0 THEN sha256(html) END AS sha, page_id FROM pages), n AS (SELECT sha, min(name) AS name FROM f WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM f WHERE page_id % 3 = 0 AND sha IS NOT NULL) AND sha NOT IN (SELECT sha FROM f WHERE page_id % 5 = 0 AND sha IS NOT NULL) GROUP BY sha)"


@query("s9_ingest_new_files", f"WITH {_FILES} SELECT * FROM n")
def _(t):
    f = settled(files(t))
    return S.new_files(f, f.where("page_id % 3 = 0"), f.where("page_id % 5 = 0")).select("sha", "name")


@query("s9_ingest_counts", f"WITH {_FILES} SELECT (SELECT count(*) FROM n) AS new, count(sha) - (SELECT count(*) FROM n) AS repeated, count(*) - count(sha) AS failed FROM f")
def _(t):
    f = settled(files(t))
    return S.ingest_counts(f, f.where("page_id % 3 = 0"), f.where("page_id % 5 = 0"))


_NAME = "concat(CASE event_id % 3 WHEN 0 THEN '2024-05-0' || CAST(event_id % 9 + 1 AS STRING) WHEN 1 THEN '24-05-01' ELSE '2024-05-011' END, ' ', event_type, CASE WHEN event_id % 4 = 0 THEN ' Chapa' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '.PNG' ELSE '.Pdf' END)"


@query("s10_filter_source_files", f"WITH x AS (SELECT event_id, {_NAME} AS name FROM events) SELECT event_id, name FROM x WHERE regexp_matches(name, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT contains(lower(name), 'chapa') AND ends_with(lower(name), '.pdf')")
def _(t):
    named = t.base("events").select("event_id", F.expr(_NAME).alias("name"))
    return named.where(S.is_source_file(c("name"), "chapa"))


@query("s11_append_validated", f"SELECT sheet_uid, CASE WHEN {N_OF} % 3 = 0 AND {N_OF} % 4 = 0 THEN 'conflict' WHEN {N_OF} % 3 = 0 THEN 'already_there' ELSE 'stored' END AS outcome, count(*) AS rows FROM facts GROUP BY sheet_uid")
def _(t):
    """A third of the sheets is there already, some of another owner; then all are sent, and sent again."""
    path = scratch_dir(t.spark)
    facts = t.facts.withColumn("owner", F.lit("own")).select("sheet_uid", "owner", "row_index", "plan_key", "qtd")
    there = facts.where(sheet_no() % 3 == 0).withColumn("owner", F.when(sheet_no() % 4 == 0, "other").otherwise("own"))
    sinks.append_new(there, path, "own")
    outcome = sinks.append_new(facts, path, "own")
    sinks.append_new(facts, path, "own")
    held = sinks.archive_rows(t.spark, path, facts.schema).groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("rows"))
    return outcome.join(held, "sheet_uid").select("sheet_uid", "outcome", "rows")


@query("s12_assign_numbers", """WITH n AS (SELECT sheet_uid, created_on, CASE WHEN sheet_no % 3 > 0 THEN sheet_no % 40 + 1 END AS proposed FROM all_sheets), k AS (SELECT *, proposed IS NOT NULL AND proposed % 7 <> 0 AND row_number() OVER (PARTITION BY proposed ORDER BY created_on, sheet_uid) = 1 AS keeps FROM n),
t AS (SELECT greatest((SELECT max(proposed) FROM k WHERE keeps), 35) AS top) SELECT sheet_uid, CAST(CASE WHEN keeps THEN proposed ELSE top + row_number() OVER (PARTITION BY keeps ORDER BY created_on, sheet_uid) END AS BIGINT) AS sheet_no FROM k, t""")
def _(t):
    """Numbers 7, 14, ... 35 were given before."""
    new = t.sheets.select("sheet_uid", "created_on", F.when(c("sheet_no") % 3 > 0, c("sheet_no") % 40 + 1).alias("proposed"))
    return sinks.assign_numbers(new, t.spark.range(7, 36, 7).withColumnRenamed("id", "sheet_no"))


@query("s13_write_stoppages", "SELECT event_id AS id, 'error' AS motivo, CASE WHEN user_id % 4 = 0 THEN '(desconhecido)' ELSE 'u' || CAST(user_id AS VARCHAR) END AS operador, CAST(event_id % 9 AS DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END AS duracao_horas FROM events WHERE event_type = 'error'")
def _(t):
    e = t.base("events").where("event_type = 'error'")
    whole = (c("event_id") % 9).cast("string")
    rows = e.select(c("event_id").alias("id"), F.concat(F.lit(" "), "event_type").alias("motivo"), F.when(c("user_id") % 4 == 0, " ").otherwise(F.concat(F.lit("u"), "user_id")).alias("operador"), F.concat(whole, F.when(c("event_id") % 2 == 0, ",5").otherwise("H")).alias("duracao"))
    return sinks.stoppages(rows)


@query("s14_write_plan_refs", f"WITH {CARRY}, {LINES} SELECT concat(sheet_uid, '#', pos) AS record_id, plan_key, assumed FROM lines")
def _(t):
    t.settle("plan_lines")
    lines = B.whole_profile_lines(L.carry_down(t.rows), t.plan)
    refs = settled(lines.select(*KEY, "plan_key", "assumed"))
    parents = refs.select(*KEY).distinct().withColumn("record_id", F.concat("sheet_uid", F.lit("#"), c("pos").cast("string")))
    return sinks.plan_refs(parents, refs.unionByName(refs))  # sent twice


@query("s16_export_union", f"SELECT sheet_uid, plan_key, row_index, sheet_date, CASE WHEN {N_OF} % 2 = 0 THEN 'archive' WHEN {N_OF} % 3 = 0 THEN 'waiting' ELSE 'draft' END AS origin FROM facts WHERE sheet_date >= DATE '1996-01-01' AND NOT (row_index = 3)")
def _(t):
    """The sheets overlap: even ones are archived, multiples of three wait, all have drafts; third rows have no date."""
    f = t.facts.select("sheet_uid", "plan_key", "row_index", F.when(c("row_index") != 3, c("sheet_date")).alias("sheet_date"))
    return S.export_rows(f.where(sheet_no() % 2 == 0), f.where(sheet_no() % 3 == 0), f, "1996-01-01")


def export_facts(t):
    line = t.plan.select("plan_key", "ov", "cliente", "perfil", "maquina", c("comp_mm").alias("plan_comp_mm"))
    f = t.facts.join(line, "plan_key").withColumn("n_operador", F.regexp_extract("operador", r"(\d+)$", 1)).withColumn("repeticoes", (c("row_index") * 2).cast("double"))
    return f.withColumn("metros", R.line_metres(c("qtd"), c("plan_comp_mm"))).withColumn("modelo", F.when(c("row_index") % 5 > 0, c("modelo")))


_EXPORT = "f AS (SELECT f.* REPLACE (CASE WHEN f.row_index % 5 > 0 THEN f.modelo END AS modelo), p.ov, p.cliente, p.perfil, p.maquina, p.comp_mm AS plan_comp_mm, regexp_extract(operador, '(\\d+)$', 1) AS n_operador, CAST(row_index * 2 AS DOUBLE) AS repeticoes, round(qtd * p.comp_mm / 1000, 3) AS metros FROM facts f JOIN plan_lines p ON p.plan_key = f.plan_key)"


@query("s17_export_basedados", f"WITH {_EXPORT} SELECT sheet_date AS data, n_operador AS operador_id, operador AS nome_operador, NULL::VARCHAR AS cod_maquina, maquina, substr(ov, 3) AS ov, substr(of_code, 3) AS of, perfil, modelo, coalesce(qtd, repeticoes) AS qtd_un, metros AS qtd_m FROM f")
def _(t):
    return S.basedados(export_facts(t))


_NULLS = lambda *names: ", ".join(f"NULL::VARCHAR AS {n}" for n in names)


@query("s18_export_cpis", f"WITH {_EXPORT} SELECT sheet_date AS data, n_operador AS cod_funcionario, operador AS nome_funcionario, maquina AS setor_maquina_desc, substr(of_code, 3) AS of, substr(ov, 3) AS ov, cliente, coalesce(modelo, perfil) AS modelo, coalesce(qtd, repeticoes) AS qtd, metros AS qtd_metros, coalesce(plan_comp_mm, comp_mm) AS comp_mm, {_NULLS('cod_maquina', 'm2', 'nesting', 'cesta_n', 'duracao', 'larg_mm', 'esp_mm', 'coni', 'n_chapas', 'peso_consumido_t', 'peso_produzido_t', 'desperdicio_t', 'desperdicio_pct', 'sucata', 'lote')} FROM f")
def _(t):
    return S.cpis(export_facts(t))


@query("s19_export_technical", f"WITH {_EXPORT} SELECT 'kanban' AS source_app, sheet_uid, row_index, sheet_date, operador AS operator_name, maquina AS machine, substr(of_code, 3) AS production_order, substr(ov, 3) AS sales_order, cliente AS customer_name, perfil AS profile_type, modelo AS model_ref, qtd AS quantity, plan_comp_mm AS length_mm, plan_comp_mm AS plan_length_mm, metros AS line_meters, plan_key AS matched_plan_key, {_NULLS('sheet_no', 'family', 'quantity_total_mm', 'duration_text', 'lot_ref', 'match_confidence', 'width_mm', 'thickness_mm', 'hours_worked', 'validated_at', 'profile_excel_o', 'material_description')} FROM f")
def _(t):
    return S.technical(export_facts(t))


@query("s20_sheet_csv", "SELECT sheet_uid, pos, row_number() OVER (PARTITION BY sheet_uid ORDER BY CASE WHEN pos % 4 = 0 THEN 100 - pos WHEN pos % 3 = 0 THEN pos + 50 ELSE pos END, pos) AS linha FROM sheet_rows WHERE pos % 11 > 0 AND trim(concat_ws('', of_written, ov_written, perfil_written, modelo_written, qtd_written, perf_comp)) <> ''")
def _(t):
    """Written as CSV and read back."""
    rows = t.rows.withColumn("display_order", F.when(c("pos") % 4 == 0, 100 - c("pos"))).withColumn("paper_position", F.when(c("pos") % 3 == 0, c("pos") + 50)).withColumn("deleted", c("pos") % 11 == 0)
    folder = scratch_dir(t.spark)
    S.sheet_lines(rows).select(*KEY, "linha").write.csv(folder, header=True)
    return t.spark.read.csv(folder, header=True, schema="sheet_uid string, pos long, linha int")


@query("s22_align_schema", "SELECT plan_key, CAST(qtd AS VARCHAR) AS qtd, NULL::DOUBLE AS duration, row_index AS row_index FROM facts")
def _(t):
    return S.align_schema(t.facts, {"plan_key": "string", "QTD": "string", "duration": "double", "row_index": "long"}).withColumnRenamed("QTD", "qtd")


@query("st1_stream_ingest", "WITH f AS (SELECT url AS name, sha256(html) AS sha, page_id FROM pages) SELECT sha, min(name) AS name FROM f WHERE sha NOT IN (SELECT sha FROM f WHERE page_id % 3 = 0) GROUP BY sha")
def _(t):
    sha = F.sha2(c("html").cast("binary"), 256)
    stream = jobs.table_stream(t.spark, f"{t.sf_dir}/pages.parquet").select(c("url").alias("name"), sha.alias("sha"))
    ledger = settled(t.base("pages").where("page_id % 3 = 0").select(sha.alias("sha")))
    return jobs.ingest(stream, ledger, jobs.new_folder(t.spark))


@query("st2_stream_evidence", "SELECT e.sheet_uid, field_path, max(id) AS id, arg_max(coalesce(new_value, ''), id) AS new_value FROM edits e JOIN all_sheets s ON s.sheet_uid = e.sheet_uid WHERE id > event_floor AND source = 'human' GROUP BY ALL")
def _(t):
    stream = t.edits_of(jobs.table_stream(t.spark, f"{t.sf_dir}/events.parquet"))
    floors = settled(t.sheets.select("sheet_uid", "event_floor"))
    return jobs.evidence(stream, floors, jobs.new_folder(t.spark))


@query("st3_stream_archive", "SELECT sheet_uid, plan_key, row_index, qtd FROM facts")
def _(t):
    """The stream is run, then run again from its beginning into the same archive."""
    folder, again = jobs.new_folder(t.spark), jobs.new_folder(t.spark)
    source = settled(t.facts.withColumn("owner", F.lit("own")).select("sheet_uid", "owner", "plan_key", "row_index", "qtd").repartition(4, "sheet_uid"))
    stream = lambda: jobs.table_stream(t.spark, source._scratch, 2)
    jobs.archive(stream(), folder, "own")
    jobs.run(stream(), lambda batch, n: sinks.append_new(batch, f"{folder}/archive", "own"), again)
    return sinks.archive_rows(t.spark, f"{folder}/archive", source.schema).select("sheet_uid", "plan_key", "row_index", "qtd")


@query("st4_stream_match", f"WITH {CARRY} SELECT sheet_uid, pos, plan_key FROM carried JOIN plan_lines ON {OKEY('of_eff')} = {OKEY('of_code')} AND modelo_written = modelo")
def _(t):
    """New sheets, whole ones in each batch, against the pinned plan: the lines of their order and model."""
    plan = settled(t.plan.select("plan_key", L.order_key(c("of_code")).alias("k"), "modelo"))
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions")) // 3 + 1
    source = settled(t.rows.repartition(3 * files, "sheet_uid"))  # three batches, however large each is

    def link(rows):
        asked = L.carry_down(rows).select(*KEY, L.order_key(c("of_eff")).alias("k"), c("modelo_written").alias("modelo"))
        return asked.join(plan, ["k", "modelo"]).select(*KEY, "plan_key")

    return jobs.match(jobs.table_stream(t.spark, source._scratch, files), link, "sheet_uid string, pos long, plan_key string", jobs.new_folder(t.spark))

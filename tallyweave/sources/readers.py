"""Reading what comes in: snapshots, batches, transcribed documents, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N

c = F.col
HEADER, ROW = ("operador", "n_operador", "setor_maquina", "data", "turno"), ("of", "ov", "perfil", "modelo", "perf_comp", "qtd")
DOCUMENT = f"struct<header:struct<{','.join(f'{f}:string' for f in HEADER)}>,rows:array<struct<{','.join(f'{f}:string' for f in ROW)}>>>"
#: Days that a plan counts as old if nobody knows when it was loaded.
UNKNOWN_AGE = 30.0


def read_plan(plan: DataFrame, snapshot_id: str) -> DataFrame:
    """One snapshot as it is: never resolved to a later one. On a table partitioned by snapshot_id only its files are read."""
    return plan.where(c("snapshot_id") == snapshot_id)


def plan_age_days(loaded_at: Column, now: Column) -> Column:
    return F.when(loaded_at.isNull(), UNKNOWN_AGE).otherwise(F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(loaded_at)) / 86400))


def latest_batch(rows: DataFrame, batches: DataFrame, dataset: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows of the batch loaded last, of a dataset or of ids with a prefix if given; ties go to the greater id."""
    if dataset:
        batches = batches.where(c("dataset_id") == dataset)
    if prefix:
        batches = batches.where(c("batch_id").startswith(prefix))
    last = batches.agg(F.max(F.struct("loaded_at", "batch_id")).alias("x")).select(c("x.batch_id").alias("batch_id"))
    return rows.join(F.broadcast(last), "batch_id")  # one row


def optional_table(tables: dict[str, DataFrame], name: str, schema: str, spark) -> DataFrame:
    """A table, or no rows of its schema where it isn't there."""
    return tables[name] if name in tables else spark.createDataFrame([], schema)


def parse_extractions(docs: DataFrame) -> DataFrame:
    """sheet_uid, pos and the cells of each row of documents (sheet_uid, json): known fields only, trimmed, blank as null.

    Rows without any cell are dropped, but a sheet keeps one row at least.
    """
    rows = docs.select("sheet_uid", F.from_json("json", DOCUMENT)["rows"].alias("rows"))
    clean = F.transform("rows", lambda r: F.struct(*(F.when(F.trim(r[f]) != "", F.trim(r[f])).alias(f) for f in ROW)))
    filled = F.filter(clean, lambda r: F.coalesce(*(r[f] for f in ROW)).isNotNull())
    return rows.select("sheet_uid", F.posexplode_outer(filled).alias("pos", "r")).select("sheet_uid", (F.coalesce("pos", F.lit(0)) + 1).cast("long").alias("pos"), *(c(f"r.{f}") for f in ROW))


def salvage_json(text: Column) -> Column:
    """A transcript as a document: without thoughts and fences around it, and if cut short with its complete rows only."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```(?:json)?\s*$", ""))
    whole = F.from_json(body, DOCUMENT).isNotNull() & body.endswith("}") & F.from_json(body, DOCUMENT)["rows"].isNotNull()
    listed = F.regexp_extract(body, r'(?s)"rows"\s*:\s*\[(.*)$', 1)
    complete = F.array_join(F.regexp_extract_all(listed, F.lit(r"(\{[^{}]*\})"), F.lit(1)), ",")
    return F.when(whole, body).otherwise(F.concat(F.lit('{"rows":['), complete, F.lit("]}")))


def is_source_file(name: Column, other_sector: str) -> Column:
    """A dated PDF that isn't another sector's."""
    return name.rlike(rf"(?i)^\d{{4}}-\d{{2}}-\d{{2}}(?!.*{other_sector}).*\.pdf$")


def new_files(files: DataFrame, ledger: DataFrame, sheets: DataFrame) -> DataFrame:
    """name, sha of pages to ingest: of files (name, sha, content) whose sha neither the ledger nor a sheet has, each content once."""
    fresh = files.where(c("sha").isNotNull()).join(ledger.select("sha"), "sha", "left_anti").join(sheets.select("sha"), "sha", "left_anti")
    return fresh.groupBy("sha").agg(F.min("name").alias("name"))


def ingest_counts(files: DataFrame, ledger: DataFrame, sheets: DataFrame) -> DataFrame:
    """new, repeated, failed: failed files (no content) are told, the others go on."""
    created = new_files(files, ledger, sheets).agg(F.count(F.lit(1)).alias("new"))
    every = files.agg(F.count_if(c("sha").isNotNull()).alias("read"), F.count_if(c("sha").isNull()).alias("failed"))
    return every.crossJoin(created).select("new", (c("read") - c("new")).alias("repeated"), "failed")  # one row each


def align_schema(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns in their types: absent ones are null, others ignored."""
    have = {x.lower() for x in df.columns}
    return df.select(*((c(n).cast(kind) if n.lower() in have else F.lit(None).cast(kind)).alias(n) for n, kind in wanted.items()))


def export_rows(archive: DataFrame, waiting: DataFrame, drafts: DataFrame | None, first_day: str | None = None) -> DataFrame:
    """What is exported: the archive, sheets not stored yet, and drafts if asked for; each sheet once, in that order.

    Under a filter by day rows without a date drop out.
    """
    out = archive.withColumn("origin", F.lit("archive"))
    for name, df in (("waiting", waiting), ("draft", drafts)):
        if df is not None:
            out = out.unionByName(df.join(out.select("sheet_uid").distinct(), "sheet_uid", "left_anti").withColumn("origin", F.lit(name)))
    return out.where(c("sheet_date") >= F.lit(first_day).cast("date")) if first_day else out


def short_code(s: Column) -> Column:
    """An order without its prefix; blank as null."""
    code = N.strip_ref_prefix(s)
    return F.when(code != "", code)


def basedados(facts: DataFrame) -> DataFrame:
    """The eleven columns of the short export."""
    none = F.lit(None).cast("string")
    return facts.select(
        c("sheet_date").alias("data"), c("n_operador").alias("operador_id"), c("operador").alias("nome_operador"), none.alias("cod_maquina"), c("maquina"), short_code(c("ov")).alias("ov"), short_code(c("of_code")).alias("of"),
        c("perfil"), c("modelo"), F.coalesce("qtd", "repeticoes").alias("qtd_un"), c("metros").alias("qtd_m"),
    )


#: The columns of the wide exports, in their order.
CPIS = ("data", "cod_funcionario", "nome_funcionario", "setor_maquina_desc", "cod_maquina", "of", "ov", "cliente", "modelo", "qtd", "qtd_metros", "m2", "nesting", "cesta_n", "duracao", "comp_mm", "larg_mm", "esp_mm", "coni", "n_chapas", "peso_consumido_t", "peso_produzido_t", "desperdicio_t", "desperdicio_pct", "sucata", "lote")
TECHNICAL = ("source_app", "sheet_no", "sheet_uid", "row_index", "sheet_date", "family", "operator_name", "machine", "production_order", "sales_order", "customer_name", "profile_type", "model_ref", "quantity", "length_mm", "quantity_total_mm", "duration_text", "lot_ref", "plan_length_mm", "line_meters", "matched_plan_key", "match_confidence", "width_mm", "thickness_mm", "hours_worked", "validated_at", "profile_excel_o", "material_description")


def cpis(facts: DataFrame) -> DataFrame:
    """The 26 columns of the contract; those that nothing fills stay null. A row without a model shows its profile."""
    given = {
        "data": c("sheet_date"), "cod_funcionario": c("n_operador").cast("string"), "nome_funcionario": c("operador"), "setor_maquina_desc": c("maquina"), "of": short_code(c("of_code")), "ov": short_code(c("ov")), "cliente": c("cliente"),
        "modelo": F.coalesce(F.when(F.trim("modelo") != "", c("modelo")), c("perfil")), "qtd": F.coalesce("qtd", "repeticoes"), "qtd_metros": c("metros"), "comp_mm": F.coalesce("plan_comp_mm", "comp_mm"),
    }
    return facts.select(*((given[n] if n in given else F.lit(None).cast("string")).alias(n) for n in CPIS))


def technical(facts: DataFrame) -> DataFrame:
    """The 28 columns of the wide dump; text that a spreadsheet would take for a formula is made harmless."""
    given = {
        "source_app": F.lit("kanban"), "sheet_uid": c("sheet_uid"), "row_index": c("row_index"), "sheet_date": c("sheet_date"), "operator_name": N.neutralize_formula(c("operador")), "machine": c("maquina"), "production_order": short_code(c("of_code")),
        "sales_order": short_code(c("ov")), "customer_name": N.neutralize_formula(c("cliente")), "profile_type": c("perfil"), "model_ref": N.neutralize_formula(c("modelo")), "quantity": c("qtd"), "length_mm": c("plan_comp_mm"), "plan_length_mm": c("plan_comp_mm"),
        "line_meters": c("metros"), "matched_plan_key": c("plan_key"),
    }
    return facts.select(*((given[n] if n in given else F.lit(None).cast("string")).alias(n) for n in TECHNICAL))


def sheet_lines(rows: DataFrame) -> DataFrame:
    """Rows as a sheet's CSV shows them: without deleted and blank ones, by their order on screen, numbered anew as linha."""
    shown = F.coalesce("display_order", "paper_position", c("pos"))
    filled = F.exists(F.array(*(f"{f}_written" for f in ("of", "ov", "perfil", "modelo", "qtd")), "perf_comp"), lambda x: F.trim(x) != "")
    kept = rows.where(~c("deleted") & F.coalesce(filled, F.lit(False)))
    return kept.withColumn("linha", F.row_number().over(Window.partitionBy("sheet_uid").orderBy(shown, "pos")))

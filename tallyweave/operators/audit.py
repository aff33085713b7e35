"""Audit events folded into evidence, reverted, compared; lists and summaries of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
PATH = r"^rows\[(\d+)\]\.([a-z_]+)$"
IDENTITY = ("of", "ov", "perfil", "modelo", "cliente")
#: Hours after which a source is late, and after which it is overdue.
LATE_HOURS, OVERDUE_HOURS = 36, 72


def of_generation(events: DataFrame, sheets: DataFrame) -> DataFrame:
    """Events of a sheet's present extraction: ids above its floor; sheets: sheet_uid, event_floor."""
    return events.join(sheets.select("sheet_uid", "event_floor"), "sheet_uid").where(c("id") > c("event_floor")).drop("event_floor")


def last_per_cell(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("id", "old_value", "new_value", "source")).alias("x")
    return events.groupBy("sheet_uid", "field_path").agg(last).select("sheet_uid", "field_path", "x.*")


def build_evidence(raw: DataFrame, events: DataFrame) -> DataFrame:
    """sheet_uid, row, field, value, source of each cell: as first read, or as a person last wrote it.

    raw: sheet_uid, row, field, value of all rows that were read. Events of the engine, of rows that are not there and of
    unknown paths don't count; a row that a person deleted has no cells.
    """
    human = events.where("source = 'human'")
    gone = human.where("new_value = '<apagada>'").select("sheet_uid", F.regexp_extract("field_path", r"^rows\[(\d+)\]$", 1).try_cast("long").alias("row")).where("row is not null").distinct()
    cells = last_per_cell(human.where(c("field_path").rlike(PATH)))
    cells = cells.select("sheet_uid", F.regexp_extract("field_path", PATH, 1).try_cast("long").alias("row"), F.regexp_extract("field_path", PATH, 2).alias("field"), c("new_value").alias("written"), F.lit(True).alias("edited"))
    there = raw.select("sheet_uid", "row").distinct()
    cells = cells.join(there, ["sheet_uid", "row"], "left_semi")
    every = raw.join(cells, ["sheet_uid", "row", "field"], "full_outer").join(gone, ["sheet_uid", "row"], "left_anti")
    edited = F.coalesce("edited", F.lit(False))
    return every.select("sheet_uid", "row", "field", F.when(edited, c("written")).otherwise(c("value")).alias("value"), F.when(edited, "human").otherwise("first_reading").alias("source"))


def explicit_bindings(bindings: DataFrame, events: DataFrame) -> DataFrame:
    """Bindings (sheet_uid, row, id) that no later human edit of the row's identity cancels."""
    touched = events.where((c("source") == "human") & c("field_path").rlike(PATH)).select("sheet_uid", F.regexp_extract("field_path", PATH, 1).try_cast("long").alias("row"), F.regexp_extract("field_path", PATH, 2).alias("field"), "id")
    last = touched.where(c("field").isin(*IDENTITY)).groupBy("sheet_uid", "row").agg(F.max("id").alias("edited"))
    return bindings.join(last, ["sheet_uid", "row"], "left").where(c("edited").isNull() | (c("edited") < c("id"))).drop("edited")


def reverts(events: DataFrame, cells: DataFrame, open_sheets: DataFrame) -> DataFrame:
    """sheet_uid, field_path, from_value, to_value: engine writes to take back.

    A cell's last engine write that changed anything is taken back if the cell still holds its value, its sheet is open and
    no person edited the cell later. cells: sheet_uid, field_path, value as they are now.
    """
    wrote = last_per_cell(events.where((c("source") == "system") & ~c("old_value").eqNullSafe(c("new_value"))))
    human = events.where("source = 'human'").groupBy("sheet_uid", "field_path").agg(F.max("id").alias("h"))
    df = wrote.join(open_sheets.select("sheet_uid").distinct(), "sheet_uid", "left_semi").join(human, ["sheet_uid", "field_path"], "left").where(c("h").isNull() | (c("h") < c("id")))
    held = df.join(cells, ["sheet_uid", "field_path"]).where(F.trim(F.coalesce("value", F.lit(""))) == F.trim(F.coalesce("new_value", F.lit(""))))
    return held.select("sheet_uid", "field_path", c("new_value").alias("from_value"), c("old_value").alias("to_value"))


def doc_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """sheet_uid, field_path, before, after of cells (sheet_uid, field_path, value) that differ, also where one side lacks it."""
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["sheet_uid", "field_path"], "full_outer")
    return both.where(~c("before").eqNullSafe(c("after"))).select("sheet_uid", "field_path", "before", "after")


def skip_reason(status: Column, template: Column, read: Column, production_rows: Column, filled_rows: Column) -> Column:
    """Why a sheet isn't linked again, the first reason that holds; null if it is."""
    return (
        F.when(status == "validated", "validated_immutable").when(status == "pending", "ocr_pending").when(template != "cantoneiras_kanban", "not_a_production_template")
        .when(~read, "no_original_transcription").when(filled_rows == 0, "empty_original_rows").when(production_rows == 0, "no_eligible_production")
    )


def preserved(rows: DataFrame, *columns: str) -> DataFrame:
    """sheet_uid and a fingerprint of the values in these columns over all its rows, in any order of the rows."""
    one = F.xxhash64(*columns).cast("decimal(20,0)")
    return rows.groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("rows"), F.sum(one).alias("print"))


def changed_prints(before: DataFrame, after: DataFrame) -> DataFrame:
    """sheet_uid of sheets whose fingerprint isn't the same on both sides."""
    return before.exceptAll(after).unionByName(after.exceptAll(before)).select("sheet_uid").distinct()


def freshness(loads: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """source, hours, state (ok, warn, crit, absent) of each expected source by its latest load before now."""
    last = loads.where(c("loaded_at") <= now).groupBy(c("dataset_id").alias("source")).agg(F.max("loaded_at").alias("at"))
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("at")) / 3600)
    state = F.when(c("at").isNull(), "absent").when(hours > OVERDUE_HOURS, "crit").when(hours > LATE_HOURS, "warn").otherwise("ok")
    return sources.join(last, "source", "left").select("source", F.round(hours, 6).alias("hours"), state.alias("state"))


def sync_summary(sheets: DataFrame) -> DataFrame:
    """pending, errors, oldest of validated sheets on their way to the archive."""
    v = sheets.where("status = 'validated'")
    return v.agg(F.count_if(c("sync_state").isin("pending", "retry")).alias("pending"), F.count_if(c("sync_state") == "error").alias("errors"), F.min(F.when(c("sync_state").isin("pending", "retry", "error"), c("validated_on"))).alias("oldest"))


def list_sheets(sheets: DataFrame, status: str | None = None, operador: str | None = None, setor: str | None = None, created_on: str | None = None) -> DataFrame:
    """Sheets by the filters that are given, the latest first. status may also be pending, avisos or a_gravar."""
    shown = {
        "pending": ~c("status").isin("validated", "error"), "avisos": (c("status") == "validated") & (c("n_warnings") > 0),
        "a_gravar": (c("status") == "validated") & c("sync_state").isin("pending", "retry", "error"),
    }
    if status:
        sheets = sheets.where(shown.get(status, c("status") == status))
    for column, value in (("operador", operador), ("setor_maquina", setor), ("created_on", created_on)):
        if value:
            sheets = sheets.where(c(column).cast("string") == value)
    return sheets.orderBy(c("created_on").desc(), c("sheet_no").desc(), c("sheet_uid").desc())


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of one page with has_more: one row beyond the page is looked for, none counted, and sorted once."""
    held = df.orderBy(*order).offset(offset).limit(limit + 1).select("*", F.row_number().over(Window.orderBy(*order)).alias("_k"))  # limit + 1 rows
    more = F.max("_k").over(Window.partitionBy(F.lit(0))) > limit
    return held.withColumn("has_more", more).where(c("_k") <= limit).drop("_k")


def after_key(df: DataFrame, keys: list[str], last: tuple, limit: int) -> DataFrame:
    """The page behind a row known by its keys: for deep pages, as nothing before it is sorted or passed over."""
    behind = F.struct(*keys) > F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, last)))
    return df.where(behind).orderBy(*keys).limit(limit)


def lookup(plan: DataFrame, q: str | None, done: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """mode, has_more and the plan lines that a search finds: by order, else sales order, else the model's beginning. The first of
    these that the plan knows decides, even if all its lines are done and therefore hidden. A blank search finds nothing.
    """
    code = (q or "").strip().upper()
    ways = (("of", c("of_code").isin(f"OF{code.removeprefix('OF')}", code)), ("ov", c("ov").isin(f"OV{code.removeprefix('OV')}", code)), ("modelo", F.upper("modelo").startswith(code)))
    for mode, hit in ways if code else ():
        found = plan.where(hit)
        if found.limit(1).count():
            shown = found if done else found.where((c("qtd_restante") > 0) | ~c("falta_valida"))
            return page(shown, [c("qtd_restante").asc_nulls_last(), c("of_code"), c("perfil"), c("modelo"), c("plan_key")], offset, limit).withColumn("mode", F.lit(mode))
    return plan.limit(0).withColumn("has_more", F.lit(False)).withColumn("mode", F.lit("none"))


def order_lines(plan: DataFrame, of: str, perfil: str | None = None) -> DataFrame:
    """An order's lines, with or without its prefix, of profiles that begin so if one is asked for, by profile and key."""
    code = of.strip().upper()
    lines = plan.where(c("of_code").isin(f"OF{code.removeprefix('OF')}", code))
    if perfil and perfil.strip():
        lines = lines.where(F.upper(F.trim("perfil")).startswith(perfil.strip().upper()))
    return lines.orderBy("perfil", "plan_key")


def contains_search(df: DataFrame, q: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with q in any of the columns, in any case; all rows for a blank q."""
    q = q.strip().lower()
    hit = F.lit(not q)
    for x in columns:
        hit = hit | F.coalesce(F.lower(x).contains(q), F.lit(False))
    return df.where(hit)


def recent_first(df: DataFrame) -> DataFrame:
    """Orders with activity, the latest first; then the others by customer and order."""
    return df.orderBy(c("last_day").isNull(), c("last_day").desc(), F.coalesce("cliente", F.lit("~")), "of_code")


def human_fields(events: DataFrame) -> DataFrame:
    """sheet_uid, row (null: header), fields that a person edited; edits of rows that changed nothing don't count."""
    human = events.where("source = 'human'")
    rows = human.where(c("field_path").rlike(PATH) & ~c("old_value").eqNullSafe(c("new_value"))).select("sheet_uid", F.regexp_extract("field_path", PATH, 1).try_cast("long").alias("row"), F.regexp_extract("field_path", PATH, 2).alias("field"))
    header = human.where(c("field_path").startswith("header.")).select("sheet_uid", F.lit(None).cast("long").alias("row"), F.substring_index("field_path", ".", -1).alias("field"))
    return rows.unionByName(header).groupBy("sheet_uid", "row").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def sheet_summary(matched: DataFrame, cells: DataFrame, metres: DataFrame, footer: DataFrame) -> DataFrame:
    """One row a sheet: rows by mode, cells by status, metres by plan and by paper, and the difference where nothing is missing.

    metres: sheet_uid, pos, metres (null: unknown); footer: sheet_uid, measured.
    """
    modes = matched.groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("rows"), F.count_if(c("mode") == "strong").alias("strong"), F.count_if(c("mode") == "weak").alias("weak"))
    states = cells.groupBy("sheet_uid").agg(*(F.count_if(c("status") == s).alias(s) for s in ("confirmed", "snapped", "very_different")))
    m = metres.groupBy("sheet_uid").agg(F.round(F.sum("metres"), 2).alias("planned"), (F.count("metres") < F.count(F.lit(1))).alias("partial"))
    df = modes.join(states, "sheet_uid", "left").join(m, "sheet_uid", "left").join(footer, "sheet_uid", "left")
    return df.withColumn("waste", F.when(~c("partial"), F.round(c("measured") - c("planned"), 2)))


def recovery_inventory(sheets: DataFrame, accounts: DataFrame, coverage: DataFrame, unready: DataFrame) -> DataFrame:
    """sheet_uid, missing_fields, unknown_rows, coverage, refresh of sheets that are still open."""
    missing = F.array_join(F.filter(F.array(*(F.when(F.trim(F.coalesce(f, F.lit(""))) == "", F.lit(f)) for f in ("operador", "n_operador", "setor_maquina", "data", "turno"))), lambda x: x.isNotNull()), ",")
    df = sheets.where(c("status").isin("extracted", "in_review")).select("sheet_uid", missing.alias("missing_fields"))
    df = df.join(accounts.select("sheet_uid", c("unknown").alias("unknown_rows")), "sheet_uid", "left").join(coverage.select("sheet_uid", c("status").alias("coverage")), "sheet_uid", "left")
    return df.join(unready.select("sheet_uid").distinct().withColumn("r", F.lit(True)), "sheet_uid", "left").withColumn("refresh", c("r").isNotNull()).drop("r")



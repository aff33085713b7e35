"""What is decided from a link: states of cells, what the plan may replace, headers, warnings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S

from .lineage import settled
from .linkage import field_key, shortened
from .sheets import link_sheets

c = F.col
KEY = ("sheet_uid", "pos")
#: How much a field matters, and how sure one must be to write one that matters so much.
CRITICALITY = (("esp", 5), ("thickness_mm", 5), ("comp_mm", 5), ("length_mm", 5), ("of", 3), ("ov", 3), ("cliente", 3), ("modelo", 3), ("lote", 3), ("nesting", 3), ("perfil", 3), ("maquina", 3))
THRESHOLDS = ((5, 0.98), (3, 0.95), (1, 0.90))
SHIFTS = ("M", "R", "XM")
FIELDS = (("of", "of_eff", "of_code"), ("ov", "ov_eff", "ov"), ("perfil", "perfil_eff", "perfil"), ("modelo", "modelo_written", "modelo"))


def write_threshold(field: Column) -> Column:
    """How sure a value of a field must be to be written."""
    level = F.coalesce(F.create_map(*(F.lit(x) for pair in CRITICALITY for x in pair))[field], F.lit(1))
    return F.create_map(*(F.lit(x) for pair in THRESHOLDS for x in pair))[level]


def same_identity(field: str, written: Column, plan: Column) -> Column:
    """The same value in another form."""
    return F.coalesce(field_key(field, written) == field_key(field, plan), F.lit(False))


def may_replace(field: str, human: Column, current: Column, proposal: Column) -> Column:
    """A person's value is only brought into the plan's form, never changed; one that a person blanked may be filled."""
    return ~human | (F.trim(F.coalesce(current, F.lit(""))) == "") | same_identity(field, current, proposal)


def plain_form(field: str, s: Column) -> Column:
    """The form in which values of a field are compared letter by letter."""
    if field == "perfil":
        return N.profile_key(s)
    return F.regexp_replace(N.normalize_code(s), f"^{field.upper()}(?=.)", "") if field in ("of", "ov") else N.normalize_code(s)


def cell_status(rows: DataFrame, plan: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """sheet_uid, pos, field, status of each cell of rows with plan_key (null: nothing found).

    known: of each field the keys that the plan has. With a line: confirmed, snapped (blank or alike), very_different, or
    na where the plan has nothing or a whole-profile row names a model. Without one: confirmed if the plan knows the value.
    Rows meet their lines once, for all fields; only those without a line are looked up among the keys.
    """
    p = plan.select("plan_key", *(c(f).alias(f"p_{n}") for n, _, f in FIELDS))
    cells = []
    for name, eff, _ in FIELDS:
        w, t = N.written(c(eff)), c(f"p_{name}")
        sim = F.when(field_key(name, w) == field_key(name, t), 1.0).otherwise(S.ratio(plain_form(name, w), plain_form(name, t)))
        ticked = F.lit(name == "modelo") & N.is_marked(c("perf_comp"))
        linked = F.when(ticked, F.when(w.isNull(), "na").otherwise("snapped")).when(F.coalesce(t, F.lit("")) == "", "na").when(w.isNull(), "snapped").when(sim >= 1, "confirmed").when(sim >= S.NEAR, "snapped").otherwise("very_different")
        cells.append(F.struct(F.lit(name).alias("field"), linked.alias("status")))
    out = rows.where(c("plan_key").isNotNull()).join(p, "plan_key", "left").select(*KEY, F.explode(F.array(*cells)).alias("x")).select(*KEY, "x.field", "x.status")
    for name, eff, _ in FIELDS:
        there = known[name].select("k").distinct().withColumn("there", F.lit(True))
        own = rows.where(c("plan_key").isNull()).select(*KEY, eff).join(there, field_key(name, c(eff)) == c("k"), "left")
        lone = F.when(N.written(c(eff)).isNull(), "na").when(c("there"), "confirmed").otherwise("unmatched")
        out = out.unionByName(own.select(*KEY, F.lit(name).alias("field"), lone.alias("status")))
    return out


def customer_cell(written: Column, name: Column, replace: bool, may_write: Column, human: Column, sure: Column) -> Column:
    """Struct of status, proposal and auto: the customer follows from the order, it is no evidence for it."""
    w = N.written(written)
    sim = F.when(w.isNull(), 0.0).otherwise(S.text_similarity(w, name))
    differs = F.coalesce(w != name, F.lit(True))
    if replace:
        inside = F.struct(F.when(w.isNotNull() & (sim >= S.NEAR), "confirmed").otherwise("snapped").alias("status"), F.when(differs, name).alias("proposal"), differs.alias("auto"))
    else:
        inside = None
    alone = (
        F.when(w.isNull(), F.struct(F.lit("snapped").alias("status"), name.alias("proposal"), (may_write & ~human & sure).alias("auto")))
        .when(sim >= S.NEAR, F.struct(F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("proposal"), F.lit(False).alias("auto")))
        .otherwise(F.struct(F.lit("alias").alias("status"), name.alias("proposal"), F.lit(False).alias("auto")))
    )
    return F.when(may_write, inside).otherwise(alone) if inside is not None else alone


def over_limit(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """sheet_uid, pos, over_limit of linked rows with a written quantity that are no whole profile."""
    q = F.when(N.looks_numeric(c("qtd_written")), N.parse_number(c("qtd_written")))
    asked = rows.where(~N.is_marked(c("perf_comp"))).join(plan.select("plan_key", "qtd_planeada"), "plan_key")
    return asked.select(*KEY, (q > c("qtd_planeada")).alias("over_limit")).where("over_limit is not null")


def total_mismatch(total: Column, pieces: Column, length: Column) -> Column:
    """A measured total that isn't pieces times length, to a millimetre; null where one isn't known."""
    return F.abs(total - pieces * length) > 1


def substitutions(rows: DataFrame, plan: DataFrame, human: DataFrame) -> DataFrame:
    """sheet_uid, pos, field, old_value, new_value: what the plan's line writes over a row's own cells.

    human: sheet_uid, pos, field of cells that a person edited.
    """
    cells = (("of", "of_written", "of_code"), ("ov", "ov_written", "ov"), ("perfil", "perfil_written", "perfil"), ("modelo", "modelo_written", "modelo"))
    touched = human.groupBy(*KEY).agg(F.collect_set("field").alias("human"))
    df = rows.select(*KEY, "plan_key", "perf_comp", *(c(own).alias(f"own_{name}") for name, own, _ in cells))
    df = df.join(plan.select("plan_key", *(c(line).alias(f"line_{name}") for name, _, line in cells)), "plan_key").join(touched, list(KEY), "left")
    found = []
    for name, _, _ in cells:
        own, line = c(f"own_{name}"), c(f"line_{name}")
        new = N.strip_ref_prefix(line) if name in ("of", "ov") else line
        edited = F.coalesce(F.array_contains("human", name), F.lit(False))
        ticked = F.lit(name == "modelo") & N.is_marked(c("perf_comp"))
        made = may_replace(name, edited, N.written(own), line) & ~ticked & ~own.eqNullSafe(new)
        found.append(F.when(made, F.struct(F.lit(name).alias("field"), own.alias("old_value"), new.alias("new_value"))))
    return df.select(*KEY, F.explode(F.array(*found)).alias("x")).where("x is not null").select(*KEY, "x.*")


def applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows with the edits' new values in their cells."""
    wide = edits.groupBy(*KEY).agg(*(F.max(F.when(c("field") == f, c("new_value"))).alias(f"_{f}") for f in ("of", "ov", "perfil", "modelo")))
    df = rows.join(wide, list(KEY), "left")
    for f in ("of", "ov", "perfil", "modelo"):
        df = df.withColumn(f"{f}_written", F.coalesce(f"_{f}", f"{f}_written")).drop(f"_{f}")
    return df


def fixed_point(rows: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 8) -> DataFrame:
    """rows after step until no row of a sheet changes; adds rounds and outcome: stable, cycle, or open after ``most``.

    A sheet leaves the loop as soon as it is stable or comes back to a state it had: later rounds hold the others only.
    Each round is written to the shared folder, so that a lost executor costs one round.
    """
    names = rows.columns
    state = F.sum(F.xxhash64(*names).cast("decimal(20,0)")).alias("state")
    open_, seen, done = settled(rows), None, []
    for i in range(1, most + 1):
        after = settled(step(open_).select(*names))
        was, now = open_.groupBy("sheet_uid").agg(state), after.groupBy("sheet_uid").agg(state)
        seen = was if seen is None else seen.unionByName(was)
        seen = settled(seen)
        kept = now.join(was.withColumnRenamed("state", "before"), "sheet_uid").join(seen.groupBy("sheet_uid").agg(F.collect_set("state").alias("all")), "sheet_uid")
        outcome = settled(kept.select("sheet_uid", F.when(c("state") == c("before"), "stable").when(F.array_contains("all", c("state")), "cycle").otherwise("open").alias("outcome")))
        ended = outcome.where("outcome <> 'open'" if i < most else "true")
        done.append(after.join(ended, "sheet_uid").withColumn("rounds", F.lit(i)))
        left = after.join(outcome.where("outcome = 'open'").select("sheet_uid"), "sheet_uid", "left_semi")
        if i == most or not left.limit(1).count():
            break
        open_ = settled(left)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def settle_sheets(rows: DataFrame, plan: DataFrame, human: DataFrame, most: int = 8) -> DataFrame:
    """rows as they stand once linking them and writing what their lines say changes nothing more; adds rounds and outcome.

    Only sheets that changed are linked again in the next round. human: sheet_uid, pos, field of cells that a person edited.
    """
    def step(open_: DataFrame) -> DataFrame:
        found = link_sheets(open_, plan).where("plan_key is not null and mode <> 'fallback'").select(*KEY, "plan_key")
        return applied(open_, substitutions(open_.join(found, list(KEY)), plan, human))

    return fixed_point(rows, step, most)


def resolve_operator(sheets: DataFrame, employees: DataFrame) -> DataFrame:
    """sheet_uid, cod, name, rule of who wrote a sheet; employees: cod, full_name. A name alone resolves nobody."""
    digits = F.translate(F.regexp_replace(c("n_operador"), r"[^\p{L}\p{N}]", ""), "Oo", "00")
    asked = sheets.select("sheet_uid", F.trim("operador").alias("name"), F.when(digits.rlike(r"^\d+$"), digits.try_cast("long")).alias("cod"))
    listed = employees.select(c("cod").alias("e_cod"), "full_name")
    known = settled(asked.join(listed, c("cod") == c("e_cod"), "left"))
    tokens = lambda s: F.filter(F.transform(F.split(F.trim(s), r"\s+"), N.compact), lambda w: w != "")
    own = F.filter(tokens(c("name")), lambda w: F.length(w) > 2)
    fits = (F.size(own) > 0) & F.forall(own, lambda w: F.exists(tokens(c("full_name")), lambda v: F.levenshtein(w, v) <= 1))
    found = known.where("e_cod is not null").select("sheet_uid", "cod", c("full_name").alias("name"), F.when(N.compact(c("name")) == N.compact(c("full_name")), "exact").when(F.coalesce(fits, F.lit(False)), "token").otherwise("so_numero").alias("rule"))
    rest = known.where("e_cod is null").select("sheet_uid", "name", "cod")
    # numbers one edit apart are equal after at most one deletion in each
    left = rest.where("cod is not null and name is not null").select("*", F.explode(shortened(c("cod").cast("string"), 1)).alias("k"))
    right = listed.select("*", F.explode(shortened(c("e_cod").cast("string"), 1)).alias("k"))
    near = left.join(right, "k").where((F.abs(c("cod") - c("e_cod")) < 10000) & (F.levenshtein(c("cod").cast("string"), c("e_cod").cast("string")) <= 1) & (F.levenshtein(N.compact(c("name")), N.compact(c("full_name"))) <= 2))
    one = near.select("sheet_uid", "e_cod", "full_name").distinct().groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("n"), F.max("e_cod").alias("e_cod"), F.max("full_name").alias("full_name")).where("n = 1")
    fixed = rest.join(one, "sheet_uid", "left")
    rule = F.when(c("e_cod").isNotNull(), "corrigido").when(c("cod").isNull(), "sem_numero").otherwise("sem_ref")
    return found.unionByName(fixed.select("sheet_uid", F.coalesce("e_cod", "cod").alias("cod"), F.coalesce("full_name", "name").alias("name"), rule.alias("rule")))


def resolve_machine(sheets: DataFrame, catalog: DataFrame, families: tuple[str, ...] = (), top: int = 3, aliases: dict[str, str] | None = None, not_in: tuple[str, ...] = ()) -> DataFrame:
    """sheet_uid, machine, status, suggestions of the machine written on a sheet; catalog: display_name.

    A written name is the catalogue's by its letters and digits, or by an alias of it; a name with a word of ``not_in`` is of
    another sector and confirms nothing. Else the most similar names of at least half are suggested: distinct written names meet the catalogue
    by length, as a name twice as long can't be half alike. families: names of several machines, which choose none.
    """
    names = catalog.select("display_name").distinct().withColumn("k", N.compact(c("display_name"))).where("k <> ''")
    for word in not_in:
        names = names.where(~c("k").contains(word))
    names = settled(names)
    values = sheets.select("setor_maquina").distinct().where(N.written(c("setor_maquina")).isNotNull()).withColumn("w", N.compact(c("setor_maquina")))
    listed = {_compact(a): _compact(b) for a, b in (aliases or {}).items()}
    meant = F.coalesce(F.create_map(*(F.lit(x) for pair in listed.items() for x in pair))[c("w")], c("w")) if listed else c("w")
    by_name = names.groupBy("k").agg(F.min("display_name").alias("machine"))
    own = values.join(by_name, c("w") == c("k"), "left").drop("k").withColumn("meant", F.when(c("machine").isNull(), meant))
    exact = own.join(by_name.toDF("meant", "by_alias"), "meant", "left").select("setor_maquina", "w", F.coalesce("machine", "by_alias").alias("machine"))
    n = F.length("w")
    asked = exact.where("machine is null and w <> ''").withColumn("n", F.explode(F.sequence(F.ceil(n / 2), 2 * n)))
    pairs = asked.join(names.withColumn("n", F.length("k").cast("long")), "n").withColumn("sim", S.ratio(c("w"), c("k"))).where("sim >= 0.5")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("setor_maquina").orderBy(c("sim").desc(), "display_name"))).where(c("r") <= top)
    suggested = best.groupBy("setor_maquina").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "display_name"))), lambda x: x["display_name"]).alias("suggestions"))
    found = exact.join(suggested, "setor_maquina", "left")
    n = F.coalesce(F.size("suggestions"), F.lit(0))
    status = F.when(c("w").isNull(), "missing").when(c("machine").isNotNull(), F.when(c("setor_maquina") == c("machine"), "confirmed").otherwise("corrected")).when(c("w").isin(*families) if families else F.lit(False), "ambiguous").when(n == 1, "review").otherwise("ambiguous")
    return sheets.select("sheet_uid", "setor_maquina").join(found, "setor_maquina", "left").select("sheet_uid", "machine", status.alias("status"), F.array_join("suggestions", ",").alias("suggestions"))


def _compact(s: str) -> str:
    """normalize.compact of a text that isn't in a table."""
    return re.sub("[^A-Z0-9]", "", unicodedata.normalize("NFKD", s).upper())


def plan_conflicts(machines: DataFrame, planned: DataFrame) -> DataFrame:
    """machines with status conflict, and the plan's machines as suggestions, where a sheet's strong rows are planned on others only.

    planned: sheet_uid, machines as plan_machines() lists them.
    """
    found = machines.join(planned.select("sheet_uid", c("machines").alias("planned")), "sheet_uid", "left")
    held = F.transform(F.split("planned", ","), N.compact)
    other = c("machine").isNotNull() & (F.coalesce(c("planned"), F.lit("")) != "") & ~F.array_contains(held, N.compact(c("machine")))
    other = F.coalesce(other, F.lit(False))
    lone = c("machine").isNull() & (F.size(held) == 1) & (c("planned") != "")
    status = F.when(other, "conflict").when(F.coalesce(lone, F.lit(False)), "review").otherwise(c("status"))
    return found.select("sheet_uid", "machine", status.alias("status"), F.when(other | F.coalesce(lone, F.lit(False)), c("planned")).otherwise(c("suggestions")).alias("suggestions"))


def check_header(sheets: DataFrame, operators: DataFrame, machines: DataFrame, human: DataFrame) -> DataFrame:
    """sheet_uid, field, status, proposal, auto of the five header fields. sheets: with assumed (a date, or null).

    A single proposal is written unless it is ambiguous or a person edited the field; the assumed date wins over the paper.
    """
    edited = human.groupBy("sheet_uid").agg(F.collect_set("field").alias("edited"))
    op = operators.select("sheet_uid", "cod", c("name").alias("o_name"), "rule")
    df = sheets.join(op, "sheet_uid", "left").join(machines.select("sheet_uid", "machine", c("status").alias("m_status"), "suggestions"), "sheet_uid", "left").join(edited, "sheet_uid", "left")
    by_hand = lambda field: F.coalesce(F.array_contains("edited", field), F.lit(False))
    text = lambda d: F.date_format(d, "dd/MM/yyyy")
    day, assumed, shift = N.canonical_date(c("data")), c("assumed"), N.compact(c("turno"))
    sure, lone = c("rule").isin("exact", "token"), F.split("suggestions", ",")
    name = F.trim("operador")
    fields = {
        "operador": (F.when(name.isNull() | (name == ""), "missing").when(sure, F.when(name == c("o_name"), "confirmed").otherwise("corrected")).when(c("rule").isin("so_numero", "corrigido"), "review").otherwise("no_reference"), F.when(c("rule").isin("exact", "token", "so_numero", "corrigido") & (name != c("o_name")), c("o_name"))),
        "n_operador": (F.when(N.written(c("n_operador")).isNull(), "missing").when(c("rule") == "corrigido", "review").when(c("rule").isin("exact", "token", "so_numero"), F.when(F.trim("n_operador") == c("cod").cast("string"), "confirmed").otherwise("corrected")).otherwise("no_reference"), F.when(c("rule").isin("exact", "token", "so_numero", "corrigido") & (F.trim("n_operador") != c("cod").cast("string")), c("cod").cast("string"))),
        "setor_maquina": (c("m_status"), F.when(c("m_status") == "corrected", c("machine")).when(c("m_status") == "review", F.get(lone, F.lit(0)))),
        "turno": (F.when(N.written(c("turno")).isNull(), "missing").when(c("turno").rlike("[+,;/|]"), "ambiguous").when(~shift.isin(*SHIFTS), "review").when(c("turno") == shift, "confirmed").otherwise("corrected"), F.when(shift.isin(*SHIFTS) & (c("turno") != shift) & ~c("turno").rlike("[+,;/|]"), shift)),
    }
    by_rule = assumed.isNotNull() & ~by_hand("data")
    written = F.trim("data")
    d_status = F.when(by_rule, F.when(written == text(assumed), "confirmed").otherwise("corrected")).when(N.written(c("data")).isNull(), "missing").when(day.isNull(), "review").when((written == text(day)) | by_hand("data"), "confirmed").otherwise("corrected")
    d_proposal = F.when(by_rule, F.when(~written.eqNullSafe(text(assumed)), text(assumed))).when(day.isNotNull() & (written != text(day)), text(day))
    fields["data"] = (d_status, d_proposal)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), status.alias("status"), proposal.alias("proposal"), by_hand(f).alias("edited")) for f, (status, proposal) in fields.items()))).alias("x")
    return df.select("sheet_uid", each).select("sheet_uid", "x.field", "x.status", "x.proposal", (c("x.proposal").isNotNull() & (c("x.status") != "ambiguous") & ~c("x.edited")).alias("auto"))


def plan_machines(matched: DataFrame, plan: DataFrame) -> DataFrame:
    """sheet_uid, machines: distinct machines of the lines that a sheet's rows are strongly linked to."""
    strong = matched.where("mode = 'strong'").select("sheet_uid", "plan_key").join(plan.select("plan_key", F.trim("maquina").alias("m")), "plan_key").where("m <> ''")
    return strong.groupBy("sheet_uid").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("machines"))


def validation_warnings(sheets: DataFrame, rows: DataFrame, current_snapshot: str) -> DataFrame:
    """sheet_uid, pos (null: of the sheet), code. Nothing blocks.

    sheets: operador, assumed, migration_conflict, plan_status, snapshot_id, stable. rows: kind, unresolved, binding_stale,
    plan_key, has_refs, mode, ticked, refs_valid, basis_status, approximate.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    no_plan = yes(c("plan_status") == "no_reference")
    of_sheet = {
        "operador_vazio": F.trim(F.coalesce("operador", F.lit(""))) == "", "data_assumida": c("assumed").isNotNull(), "conflito_migracao": c("migration_conflict"), "plano_indisponivel": no_plan,
        "plano_mudou": ~no_plan & (c("snapshot_id") != current_snapshot), "cruzamento_instavel": ~c("stable"),
    }
    lost = c("plan_key").isNull() & ~c("has_refs")
    unready = ~yes(c("refs_valid")) | ~yes(c("basis_status") == "ready")
    of_row = {
        "identidade_por_confirmar": c("unresolved"), "escolha_de_outra_carga": c("binding_stale"), "sem_ligacao_ao_plano": lost, "correspondencia_fraca": ~lost & (c("mode") == "weak"),
        "saldo_por_confirmar": c("ticked") & unready, "saldo_aproximado": c("ticked") & ~unready & c("approximate"),
    }
    pick = lambda rules: F.explode(F.filter(F.array(*(F.when(yes(rule), F.lit(code)) for code, rule in rules.items())), lambda x: x.isNotNull())).alias("code")
    first = sheets.select("sheet_uid", F.lit(None).cast("long").alias("pos"), pick(of_sheet))
    return first.unionByName(rows.where(~c("kind").isin("activity", "empty", "deleted")).select(*KEY, pick(of_row)))


def row_accounting(rows: DataFrame) -> DataFrame:
    """sheet_uid, included, physical, justified, removed, unknown, least, most: what became of a sheet's rows.

    rows: filled, deleted, reason, duplicate_of (a pos). A duplicate counts only if it points at another live, filled row.
    """
    live = rows.where("filled and not deleted").select("sheet_uid", c("pos").alias("duplicate_of")).distinct().withColumn("lives", F.lit(True))
    df = rows.join(live, ["sheet_uid", "duplicate_of"], "left").withColumn("lives", F.when(c("duplicate_of") != c("pos"), c("lives")))
    valid = F.when(c("reason") == "duplicate", c("lives").isNotNull()).otherwise(c("reason").isin("out_of_scope", "ocr_artifact"))
    count = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("long"))
    gone = c("deleted")
    g = df.withColumn("ok", F.coalesce(valid, F.lit(False))).groupBy("sheet_uid").agg(
        count(~gone & c("filled")).alias("included"), count(gone & c("ok") & (c("reason") == "out_of_scope") & c("filled")).alias("physical"),
        count(gone & c("ok")).alias("justified"), count(gone).alias("removed"), count(gone & ~c("ok") & c("filled")).alias("unknown"),
    )
    return g.withColumn("least", c("included") + c("physical")).withColumn("most", c("least") + c("unknown"))


def coverage_status(accounts: DataFrame) -> DataFrame:
    """sheet_uid, status, stale of accounts with expected, confirmed (counts or null), context_now and context_then."""
    fits = lambda n: F.coalesce(c(n).between(c("least"), c("most")), F.lit(False))
    same = F.coalesce(c("context_now") == c("context_then"), F.lit(False))
    human, resolved = same & fits("confirmed"), same & (fits("confirmed") | fits("expected"))
    status = F.when(resolved, F.when(human | (c("unknown") == 0), "complete").otherwise("reviewed")).when(c("expected").isNull(), "unverified").otherwise("incomplete")
    return accounts.select("sheet_uid", status.alias("status"), (~same).alias("stale"))


def fill_header(first: DataFrame, second: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """sheet_uid, field, value, outcome: a second reading fills blanks only; where both differ it is a proposal or a conflict."""
    out = None
    both = first.select("sheet_uid", *(c(f).alias(f"a_{f}") for f in fields)).join(second.select("sheet_uid", *(c(f).alias(f"b_{f}") for f in fields)), "sheet_uid", "left")
    for f in fields:
        a, b = N.written(c(f"a_{f}")), N.written(c(f"b_{f}"))
        clash = F.coalesce(N.canonical_date(a) != N.canonical_date(b), F.lit(False)) if f == "data" else F.lit(False)
        outcome = F.when(b.isNull() | (a == b), "kept").when(a.isNull(), "filled").when(clash, "conflict").otherwise("proposal")
        part = both.select("sheet_uid", F.lit(f).alias("field"), F.coalesce(a, b).alias("value"), outcome.alias("outcome"))
        out = part if out is None else out.unionByName(part)
    return out


def reattach(bindings: DataFrame, plan: DataFrame) -> DataFrame:
    """sheet_uid, pos, plan_key, reattached: an old choice goes to the plan's line of the same identity if there is just one."""
    p = plan.select(field_key("of", c("of_code")).alias("k"), c("plan_key").alias("new_key"), field_key("modelo", c("modelo")).alias("pm"), field_key("perfil", c("perfil")).alias("pp"), c("comp_mm").alias("pl"))
    same = (c("pm") == field_key("modelo", c("modelo"))) & (c("pp") == field_key("perfil", c("perfil"))) & (c("comp_mm").isNull() | (F.abs(c("pl") - c("comp_mm")) <= 1))
    hits = bindings.withColumn("k", field_key("of", c("of"))).join(p, "k").where(same).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("new_key").alias("new_key")).where("n = 1")
    out = bindings.join(hits, list(KEY), "left")
    return out.select(*KEY, F.coalesce("new_key", "plan_key").alias("plan_key"), c("new_key").isNotNull().alias("reattached"))


def apply_explicit(matched: DataFrame, bindings: DataFrame, plan: DataFrame, snapshot: str) -> DataFrame:
    """sheet_uid, pos, plan_key, mode, stale: a choice of this snapshot with a valid key wins; any other is flagged, not used."""
    held = plan.select(c("plan_key").alias("bound"), F.lit(True).alias("held")).distinct()
    b = bindings.select(*KEY, c("plan_key").alias("bound"), "snapshot_id").join(held, "bound", "left")
    df = matched.select(*KEY, "plan_key", "mode").join(b, list(KEY), "left")
    wins = F.coalesce((c("snapshot_id") == snapshot) & c("held"), F.lit(False))
    return df.select(*KEY, F.when(wins, c("bound")).otherwise(c("plan_key")).alias("plan_key"), F.when(wins, "explicit").otherwise(c("mode")).alias("mode"), (c("bound").isNotNull() & ~wins).alias("stale"))


SOURCES = ("frozen", "children", "pinned")


def recover_refs(facts: DataFrame, frozen: DataFrame, children: DataFrame, pinned: DataFrame) -> DataFrame:
    """sheet_uid, pos, source, refs, quantity, problem: the first source that has anything wins; zero is kept, today's plan never used."""
    df = facts.select(*KEY).distinct()
    for name, lines in zip(SOURCES, (frozen, children, pinned), strict=True):
        df = df.join(lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("quantity").alias(f"q_{name}")), list(KEY), "left")
    return recovered(df)


def recovered(totals: DataFrame) -> DataFrame:
    """recover_refs() of rows that have the number of lines and the sum of each source: n_frozen, q_frozen and so on."""
    source = F.coalesce(*(F.when(c(f"n_{x}") > 0, x) for x in SOURCES))
    first = lambda p: F.coalesce(*(F.when(c(f"n_{x}") > 0, F.struct(c(f"{p}_{x}").alias("v"))) for x in SOURCES))["v"]
    return totals.select(*KEY, source.alias("source"), first("n").alias("refs"), first("q").alias("quantity"), F.when(source.isNull(), "no_source").when(first("q").isNull(), "unknown_quantity").alias("problem"))


def align_rows(candidates: DataFrame, original: DataFrame) -> DataFrame:
    """sheet_uid, pos, original_pos: where rows of a second reading stand in the first.

    Rows whose key is unique in both readings are anchors. Between two that follow each other a gap is filled if it is as
    long in both; a sheet whose anchors change their order gives nothing.
    """
    lone = lambda df, name: df.groupBy("sheet_uid", "key").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias(name)).where("n = 1").drop("n")
    anchors = lone(candidates, "a").join(lone(original, "b"), ["sheet_uid", "key"])
    order = Window.partitionBy("sheet_uid").orderBy("a")
    steady = anchors.withColumn("back", c("b") <= F.lag("b").over(order)).groupBy("sheet_uid").agg(F.max(F.coalesce("back", F.lit(False))).alias("bad")).where("not bad").select("sheet_uid")
    anchors = anchors.join(steady, "sheet_uid", "left_semi")
    line = candidates.select("sheet_uid", "pos").join(anchors.select("sheet_uid", c("a").alias("pos"), F.struct("a", "b").alias("x")), ["sheet_uid", "pos"], "left")
    by = Window.partitionBy("sheet_uid").orderBy("pos")
    line = line.withColumn("p", F.last("x", True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first("x", True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    same = c("n.a") - c("p.a") == c("n.b") - c("p.b")
    return line.where(same).select("sheet_uid", "pos", (c("p.b") + c("pos") - c("p.a")).alias("original_pos"))



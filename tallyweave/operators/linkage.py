"""Linking sheet rows to plan lines: carry-down, candidates, evidence, ranking, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S

from .lineage import settled

c = F.col
CARRIED = ("of", "ov", "perfil")
TOP_K = 10
#: Parts in which the values of one length are held against others, as most codes have the same length.
PARTS = 32
#: Lines of a value that are held together; a commoner value has several such lists.
LISTED = 1024
#: Lines of a value from which on it gives no candidates alone; an order always does.
CAP = 500
IDENTITY = (("of_eff", "of_code", None), ("ov_eff", "ov", CAP), ("modelo_written", "modelo", CAP), ("perfil_eff", "perfil", CAP))


def carry_down(rows: DataFrame, within: tuple[str, ...] = ("sheet_uid",)) -> DataFrame:
    """Adds <f>_eff and <f>_from for carried fields: a blank or ditto cell takes the last value of its block.

    A row without content ends a block, and so does an order that is not the one before it (similarity below 0.9). The
    customer is carried where rows have cliente_written. Optional columns: deleted (such a row neither gives, takes nor
    ends), manual (entered by hand: takes nothing), cleared (array of fields that a person emptied: these stay empty).
    Other columns that end in _written count as content. Blocks are numbered within ``within``.
    """
    held = rows.columns
    carried = CARRIED + (("cliente",) if "cliente_written" in held else ())
    by_sheet = Window.partitionBy(*within).orderBy("pos")
    before = by_sheet.rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(c("deleted"), F.lit(False)) if "deleted" in held else F.lit(False)
    for f in carried:
        rows = rows.withColumn(f"_{f}", F.when(~gone, N.written(c(f"{f}_written"))))
    content = [N.written(c(x)) for x in held if x.endswith("_written") and x.removesuffix("_written") not in carried]
    content += [N.written(c("perf_comp"))] if "perf_comp" in held else []
    mute = ~gone & F.coalesce(*(c(f"_{f}") for f in carried), *content).isNull()
    last = F.last("_of", True).over(before)
    new = mute | (c("_of").isNotNull() & (last.isNull() | (S.code_similarity(c("_of"), last) < 0.9)))
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(by_sheet)).withColumn("mute", mute | gone)
    so_far = Window.partitionBy(*within, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for f in carried:
        shut = F.lit(False)
        if "manual" in held:
            shut = shut | F.coalesce(c("manual"), F.lit(False))
        if "cleared" in held:
            shut = shut | F.coalesce(F.array_contains("cleared", f), F.lit(False))
        takes = ~c("mute") & (~shut | c(f"_{f}").isNotNull())
        source = F.last(F.when(c(f"_{f}").isNotNull(), c("pos")), True).over(so_far)
        rows = rows.withColumn(f"{f}_eff", F.when(takes, F.last(f"_{f}", True).over(so_far))).withColumn(f"{f}_from", F.when(takes, source))
    return rows.drop("mute", *(f"_{f}" for f in carried))


def order_key(s):
    """An order's key with or without its prefix."""
    return F.regexp_replace(N.zero_o_key(s), "^0F", "")


def listed(lines: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and lists of its lines' columns: a row meets a list, not line after line, and pairs come out of it in the order of
    keys, in which they take little room."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return lines.withColumn("_n", F.floor((number - 1) / LISTED)).groupBy(key, "_n").agg(F.collect_list(F.struct(*columns)).alias("lines")).drop("_n")


def exact_candidates(rows: DataFrame, plan: DataFrame, written: str, field: str, cap: int | None = None) -> DataFrame:
    """sheet_uid, pos, plan_key where keys agree; with a cap, only by values on at most that many plan lines."""
    keyed = plan.select(order_key(c(field)).alias("k"), "plan_key")
    if cap:
        common = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(c("m") <= cap).select("k")
        keyed = keyed.join(common, "k", "left_semi")
    return rows.where(c(written).isNotNull()).select("sheet_uid", "pos", order_key(c(written)).alias("k")).join(keyed, "k").select("sheet_uid", "pos", "plan_key")


def _keyed(rows: DataFrame, plan: DataFrame, fields: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """Rows and lines once each, with the keys k0, k1 ... of (written, field); lines' as l0, l1 ..."""
    asked = rows.select("sheet_uid", "pos", *(order_key(c(w)).alias(f"k{i}") for i, (w, _) in enumerate(fields)))
    return asked, plan.select("plan_key", *(order_key(c(f)).alias(f"l{i}") for i, (_, f) in enumerate(fields)))


def exact_in_all(rows: DataFrame, plan: DataFrame, fields: tuple[tuple[str, str], ...]) -> DataFrame:
    """sheet_uid, pos, plan_key where the keys of every (written, field) agree: one join on all of them, so that no pair is
    formed that agrees in some only."""
    asked, keyed = _keyed(rows, plan, fields)
    agree = reduce(lambda x, y: x & y, (c(f"k{i}") == c(f"l{i}") for i in range(len(fields))))
    return asked.join(keyed, agree).select("sheet_uid", "pos", "plan_key").distinct()


def exact_in_any(rows: DataFrame, plan: DataFrame, fields: tuple[tuple[str, str], ...]) -> DataFrame:
    """sheet_uid, pos, plan_key where the keys of at least one (written, field) agree, each pair once.

    A pair comes from the first field in which it agrees. Rows and lines are made distinct before they are joined, so that
    pairs, of which there are many more, need not be gathered. The fields must follow from sheet_uid, pos and plan_key.
    """
    asked, keyed = (settled(x.distinct()) for x in _keyed(rows, plan, fields))
    found = []
    for i in range(len(fields)):
        new = reduce(lambda x, y: x & y, (~F.coalesce(c(f"k{j}") == c(f"l{j}"), F.lit(False)) for j in range(i)), F.lit(True))
        found.append(asked.join(keyed, c(f"k{i}") == c(f"l{i}")).where(new).select("sheet_uid", "pos", "plan_key"))
    return reduce(DataFrame.unionByName, found)


def shortened(s, most: int):
    """s and all that is left of it without at most so many of its characters."""
    out = F.array(s)
    for _ in range(most):
        less = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.concat(F.array(x), less(x)))))
    return out


def fuzzy_top(values: DataFrame, known: DataFrame, k: int = TOP_K, least: float = 0.6, by: str | None = None, falling: bool = True) -> DataFrame:
    """w, v, sim, rank: for each distinct written value the k most similar known ones, lengths within three.

    Values at most d edits apart are equal after at most d deletions in each, so they join by equality. Whoever has k
    of these that are more similar than d + 1 edits allow is done, and so is whoever meets no length that allows more than two
    edits; only the others are held against all of near length. With ``by``, values meet those of their own field only.
    Ties go by value, falling or rising. Joins are by sorting: files of codes are small for what they hold, and Spark
    would send whole tables, with all shortened values, through the driver.
    """
    own = [by] if by else []
    rest, out = settled(values.where("w is not null")), []
    known = known.where("v is not null")
    longest = F.greatest(F.length("w"), F.length("v"))
    rank = F.row_number().over(Window.partitionBy(*own, "w").orderBy(c("sim").desc(), c("v").desc() if falling else c("v")))
    edits = lambda n: F.floor((1 - least) * n + 1e-9)

    def best(pairs: DataFrame) -> DataFrame:
        alike = pairs.where(F.levenshtein("w", "v") <= edits(longest)).withColumn("sim", S.ratio(c("w"), c("v"))).where(c("sim") >= least)
        return alike.withColumn("rank", rank).where(c("rank") <= k).select(*own, "w", "v", "sim", "rank")

    near = lambda n: F.explode(F.sequence(F.greatest(n - 3, F.lit(1)), n + 3)).alias("n")
    lengths = known.select(*own, F.length("v").alias("n")).distinct()
    most = rest.select(*own, "w", near(F.length("w"))).join(F.broadcast(lengths), [*own, "n"])  # a row for each length that values have
    wide = most.groupBy(*own, "w").agg(F.max(edits(F.greatest(F.length("w"), "n"))).alias("most")).where("most > 2").select(*own, "w")
    rest = settled(rest.join(wide.withColumn("wide", F.lit(True)).hint("merge"), [*own, "w"], "left"))
    for d in (1, 2):
        pairs = rest.select(*own, "w", "wide", F.explode(shortened(c("w"), d)).alias("n")).join(known.select(*own, "v", F.explode(shortened(c("v"), d)).alias("n")).hint("merge"), [*own, "n"]).select(*own, "w", "v", "wide").distinct()
        sure = S.ratio(c("w"), c("v")) > 1 - (d + 1) / (F.length("w") + 3)
        if d == 2:
            sure = sure | c("wide").isNull()
        top = settled(best(pairs.where((F.abs(F.length("w") - F.length("v")) <= 3) & sure)))
        done = top.where(c("rank") == k).select(*own, "w")
        if d == 2:
            done = done.unionByName(rest.where("wide is null").select(*own, "w")).distinct()
        out.append(top.join(done.hint("merge"), [*own, "w"], "left_semi"))
        rest = settled(rest.join(done.hint("merge"), [*own, "w"], "left_anti"))
    asked = rest.select(*own, "w", near(F.length("w"))).join(F.broadcast(lengths), [*own, "n"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    held = known.select(*own, "v", F.length("v").alias("n"), F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int").alias("part"))
    out.append(best(asked.join(held.hint("merge"), [*own, "n", "part"])))
    return reduce(DataFrame.unionByName, out)


def tolerance_join(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """Pairs with |x - y| <= tolerance. Rows of one value are held in lists; lists meet by buckets of a quarter of the
    tolerance and those around, and give their pairs list by list, so that no row is held against others one after another
    and a file of pairs repeats the same short runs."""
    width, near = tolerance / 4, 5  # four buckets reach as far as the tolerance; one more for what division rounds
    parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by the pairs to come
    bucket = F.floor(c("_v") / width)

    def lists(df: DataFrame, value: str, name: str) -> DataFrame:
        return listed(df.where(c(value).isNotNull()).withColumn("_v", c(value)), "_v", *df.columns).withColumnRenamed("lines", name)

    ours = lists(left, x, "_l").withColumn("_b", F.explode(F.sequence(bucket - near, bucket + near))).withColumnRenamed("_v", "_x").repartition(parts, "_b")
    theirs = lists(right, y, "_r").withColumn("_b", bucket).withColumnRenamed("_v", "_y").repartition(parts, "_b")
    pairs = ours.join(theirs, "_b").where(F.abs(c("_x") - c("_y")) <= tolerance).select(F.explode("_l").alias("_l"), "_r")
    return pairs.select("_l.*", F.explode("_r").alias("_r")).select(*left.columns, "_r.*")


def field_key(field: str, s):
    """What must be equal for an exact hit: codes with or without their prefix, profiles in the plan's form."""
    if field == "perfil":
        return N.profile_key(s)
    return F.regexp_replace(N.zero_o_key(s), "^0[FV]" if field == "ov" else "^0F", "")


def field_form(field: str, s):
    """The form in which fuzzy hits are looked for."""
    return N.profile_key(s) if field == "perfil" else N.normalize_code(s)


def lines_of(rows: DataFrame, hits: DataFrame, keyed: DataFrame, written: str, on: str) -> DataFrame:
    return rows.select("sheet_uid", "pos", written).join(hits, written).join(keyed.select(on, "plan_key"), on).select("sheet_uid", "pos", "plan_key")


def candidates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The lines of the row's order where the plan has it. Else the exact hits of each identity field and, for a field
    without any, the lines of its most similar values; values on more than CAP lines give none, except orders. A row
    that finds nothing so takes its exact hits however many.
    """
    by_order = exact_candidates(rows, plan, "of_eff", "of_code")
    orders = plan.select(order_key(c("of_code")).alias("k")).distinct()
    rest = settled(rows.select("sheet_uid", "pos", *(w for w, _, _ in IDENTITY)).join(orders, order_key(c("of_eff")) == c("k"), "left_anti"))
    found, again = [], []
    for written, field, cap in IDENTITY:
        values = settled(rest.where(N.written(c(written)).isNotNull()).select(written).distinct().select(written, field_key(field, c(written)).alias("k"), field_form(field, c(written)).alias("w")))
        forms = settled(plan.groupBy(field).agg(F.count(F.lit(1)).alias("m")).select(field, "m", field_key(field, c(field)).alias("k"), field_form(field, c(field)).alias("v")).where((c("v") != "") & (c("k") != "")))
        keyed = plan.select(field, "plan_key").join(forms.select(field, "k", "v"), field)
        few = c("m") <= cap if cap else F.lit(True)
        exact = values.join(forms.groupBy("k").agg(F.sum("m").alias("m")).where(few), "k").select(written, "k")
        pending = values.where("w != ''").join(exact, written, "left_anti")
        known = forms.groupBy("v").agg(F.sum("m").alias("m"))
        near = settled(fuzzy_top(pending.select("w").distinct(), known.select("v")).join(known.where(few), "v").join(pending, "w").select(written, "v"))
        found += [lines_of(rest, exact, keyed, written, "k"), lines_of(rest, near, keyed, written, "v")]
        again.append((written, values.select(written, "k"), keyed))
    once = settled(reduce(DataFrame.unionByName, found).distinct())
    none = rest.join(once, ["sheet_uid", "pos"], "left_anti")
    uncapped = reduce(DataFrame.unionByName, (lines_of(none, values, keyed, written, "k") for written, values, keyed in again)).distinct()
    return by_order.unionByName(once).unionByName(uncapped)


def anchored_candidates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The lines of the row's order where the plan has it; else the exact hits of each field under the cap."""
    by_order = exact_candidates(rows, plan, "of_eff", "of_code")
    return by_order.unionByName(_exact(without_order(rows, plan), plan, CAP).distinct())


def uncapped_candidates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For rows without any exact candidate under the cap, all exact hits."""
    rest = settled(without_order(rows, plan))
    none = rest.join(_exact(rest, plan, CAP).select("sheet_uid", "pos").distinct(), ["sheet_uid", "pos"], "left_anti")
    return _exact(none, plan, None).distinct()


def without_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    orders = plan.select(order_key(c("of_code")).alias("k")).distinct()
    return rows.join(orders, order_key(c("of_eff")) == c("k"), "left_anti")


def _exact(rows: DataFrame, plan: DataFrame, cap: int | None) -> DataFrame:
    found = []
    for written, field, _ in IDENTITY[1:]:
        keyed = plan.select(field_key(field, c(field)).alias("k"), "plan_key")
        if cap:
            few = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(c("m") <= cap).select("k")
            keyed = keyed.join(few, "k", "left_semi")
        asked = rows.where(N.written(c(written)).isNotNull()).select("sheet_uid", "pos", field_key(field, c(written)).alias("k"))
        found.append(asked.join(keyed, "k").select("sheet_uid", "pos", "plan_key"))
    return reduce(DataFrame.unionByName, found)


def effective_rows(carried: DataFrame) -> DataFrame:
    """Adds of, ov, perfil (the cell's own value, else what is carried to it) and of_inherited."""
    for f in CARRIED:
        carried = carried.withColumn(f, F.coalesce(N.written(c(f"{f}_written")), c(f"{f}_eff")))
    return carried.withColumn("of_inherited", F.coalesce(c("of_from") != c("pos"), F.lit(False)))


def measure_m(rows: DataFrame, plan: DataFrame, least: int = 30) -> DataFrame:
    """field, m, total: how often a written value agrees with its true line's, for fields written often enough."""
    pairs = rows.join(plan.select(c("plan_key").alias("true_plan_key"), "of_code", "ov", "modelo"), "true_plan_key")
    sim = lambda w, f: F.when(field_key(f, c(w)) == field_key(f, c(f)), 1.0).otherwise(S.code_similarity(c(w), c(f)))
    fields = (("of", "of_written", "of_code"), ("ov", "ov_written", "ov"), ("modelo", "modelo_written", "modelo"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.when(N.written(c(w)).isNotNull(), sim(w, f)).alias("sim")) for n, w, f in fields))).alias("x")
    found = pairs.select(each).select("x.*").where("sim is not null").groupBy("field")
    return found.agg(F.round(F.avg((c("sim") >= 1).cast("double")), 4).alias("m"), F.count(F.lit(1)).alias("total")).where(c("total") >= least)


def exclusions(labels: DataFrame, plan: DataFrame) -> DataFrame:
    """sheet_uid, labels, missing_lines, missing_orders: labels whose line, or order, the plan lacks."""
    lines = plan.select(c("plan_key").alias("true_plan_key"), F.lit(True).alias("line")).distinct()
    orders = plan.select("of_code", F.lit(True).alias("order")).distinct()
    found = labels.join(lines, "true_plan_key", "left").join(orders, "of_code", "left")
    lost = lambda x: F.sum(c(x).isNull().cast("long"))
    return found.groupBy("sheet_uid").agg(F.count(F.lit(1)).alias("labels"), lost("line").alias("missing_lines"), lost("order").alias("missing_orders"))


def label_join(matched: DataFrame, truth: DataFrame, plan: DataFrame) -> DataFrame:
    """sheet_uid, pos, evaluable, right_line of each labelled row; only labels in the plan can be judged."""
    held = plan.select(c("plan_key").alias("true_plan_key"), F.lit(True).alias("held")).distinct()
    rows = truth.join(held, "true_plan_key", "left").join(matched.select("sheet_uid", "pos", "plan_key"), ["sheet_uid", "pos"], "left")
    right = F.coalesce(c("plan_key") == c("true_plan_key"), F.lit(False))
    return rows.select("sheet_uid", "pos", c("held").isNotNull().alias("evaluable"), F.when(c("held").isNotNull(), right).alias("right_line"))


#: A character for each of these that it is mistaken for.
CONFUSED = ("05186249A3", "OSIBGZAG48")


def glyph_noise(lines: DataFrame) -> DataFrame:
    """lines (modelo, cliente, n) as badly read, by arithmetic on n: a character lost or confused, a name cut short."""
    i = (c("n") % F.length("modelo")).cast("int") + 1
    before, at, behind = F.substr("modelo", F.lit(1), i - 1), F.substr("modelo", i, F.lit(1)), F.substr("modelo", i + 1)
    read = F.when(c("n") % 3 == 0, F.concat(before, behind)).when(c("n") % 3 == 1, F.concat(before, F.translate(at, *CONFUSED), behind)).otherwise(c("modelo"))
    return lines.withColumn("cliente", F.when(c("n") % 4 == 0, F.substring("cliente", 1, 9)).otherwise(c("cliente"))).withColumn("modelo", read)


def weights(plan: DataFrame, field: str) -> DataFrame:
    """Bits of each value of a plan field."""
    total = plan.agg(F.count(F.lit(1)).alias("total"))
    return plan.groupBy(field).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select(field, S.value_weight(c("n"), c("total")).alias(f"w_{field}"))  # one row


def score_pairs(rows: DataFrame, plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """bits (micro) and agree of each pair. Evidence is computed on distinct pairs of values and joined back."""
    base = pairs.join(rows.select("sheet_uid", "pos", "of_eff", "ov_eff", "perfil_eff", "modelo_written"), ["sheet_uid", "pos"]).join(plan.select("plan_key", "of_code", "ov", "perfil", "modelo"), "plan_key")
    p = base = settled(base)
    total, agree = F.lit(0).cast("long"), F.lit(0)
    for written, field, code in (("of_eff", "of_code", True), ("ov_eff", "ov", True), ("perfil_eff", "perfil", False), ("modelo_written", "modelo", True)):
        if field == "perfil":
            form = N.profile_key
            same = form(c(written)) == form(c(field))
        else:
            form = lambda x: F.regexp_replace(N.compact(x), "^O[FV]", "")
            same = order_key(c(written)) == order_key(c(field))
        distinct = base.where(c(written).isNotNull()).select(written, field).distinct().withColumn("x", form(c(written))).withColumn("y", form(c(field)))
        distinct = distinct.withColumn("sim", F.when(same, 1.0).otherwise(S.ratio(c("x"), c("y")))).join(weights(plan, field), field)
        alike = F.when(c("sim") < S.NEAR, S.look_alike_evidence(c("x"), c("y")))  # it decides below that only
        distinct = distinct.withColumn("channel", S.channel_floor(c("sim"), F.coalesce(alike, F.lit(0.0))))
        present = F.lit(False)
        if code:
            there = plan.select(field_key(field, c(field)).alias("k"), F.lit(True).alias("present")).distinct()
            distinct, present = distinct.join(there, field_key(field, c(written)) == c("k"), "left"), c("present").isNotNull()
        bits = S.identity_bits(c("sim"), c("channel"), c(f"w_{field}"), present, F.lit(False), code)
        scored = distinct.select(written, field, S.micro_bits(bits).alias(f"b_{field}"), (c("sim") >= 0.55).cast("int").alias(f"a_{field}"))
        p = p.join(scored, [written, field], "left")
        total, agree = total + F.coalesce(f"b_{field}", F.lit(0)), agree + F.coalesce(f"a_{field}", F.lit(0))
    return p.select("sheet_uid", "pos", "plan_key", "of_code", "modelo", "perfil", total.alias("bits"), agree.cast("long").alias("agree"))


def _code_form(s):
    return F.regexp_replace(N.compact(s), "^O[FV]", "")


def score_by_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """score_pairs() of all rows with the lines of their orders, without a table of pairs: what is compared is made once for
    each row and each line, with the line's weights and whether the plan knows the written value, and both meet by order once.
    """
    fields = (("ov_eff", "ov", True), ("perfil_eff", "perfil", False), ("modelo_written", "modelo", True))
    asked, lines = rows.where("of_eff is not null"), plan.select("plan_key", "of_code", "ov", "perfil", "modelo")
    for written, field, code in fields:
        lines = lines.join(weights(plan, field), field, "left")
        if code:
            there = plan.select(field_key(field, c(field)).alias("q")).where("q is not null").distinct().withColumn(f"p_{field}", F.lit(True))
            asked = asked.withColumn("q", field_key(field, c(written))).join(there, "q", "left")
    forms = lambda name, s, code: [*([order_key(s).alias(f"k{name}")] if code else []), F.when(s.isNotNull(), (_code_form if code else N.profile_key)(s)).alias(f"x{name}")]
    alike = lambda side: [S.look_alike_form(c(f"x{side}_{field}")).alias(f"f{side}_{field}") for _, field, _ in fields]
    parts = 4 * int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by the pairs to come: few bytes make many
    asked = asked.withColumn("k", order_key(c("of_eff"))).repartition(parts, "k")
    asked = asked.select("sheet_uid", "pos", "k", "p_ov", "p_modelo", *(x for w, f, code in fields for x in forms(f"w_{f}", c(w), code))).select("*", *alike("w"))
    lines = lines.join(weights(plan, "of_code"), "of_code").withColumn("k", order_key(c("of_code"))).where("k is not null").repartition(parts, "k")
    lines = lines.select("*", *(x for _, f, code in fields for x in forms(f"v_{f}", c(f), code))).select("*", *alike("v"))
    pairs = asked.join(listed(lines, "k", *(x for x in lines.columns if x != "k")), "k").withColumn("x", F.explode("lines")).drop("lines", "k").select("*", "x.*")
    total, agree = S.micro_bits(c("w_of_code")), F.lit(1).cast("long")
    for _, field, code in fields:
        x, y, w = c(f"xw_{field}"), c(f"xv_{field}"), c(f"w_{field}")
        same = ((c(f"kw_{field}") == c(f"kv_{field}")) | (x == y)) if code else x == y
        sim = c(f"s_{field}")
        pairs = pairs.withColumn(f"s_{field}", F.when(x.isNotNull() & y.isNotNull(), F.when(same, 1.0).otherwise(S.ratio(x, y))))
        pairs = pairs.withColumn(f"g_{field}", F.when(sim < S.NEAR, S.near_look_alike(x, y, c(f"fw_{field}"), c(f"fv_{field}"))).otherwise(0.0))
        bits = S.identity_bits(sim, S.channel_floor(sim, c(f"g_{field}")), w, c(f"p_{field}").isNotNull() if code else F.lit(False), F.lit(False), code)
        total, agree = total + F.when(sim.isNull(), 0).otherwise(S.micro_bits(bits)), agree + F.coalesce((sim >= 0.55).cast("long"), F.lit(0))
    return pairs.select("sheet_uid", "pos", "plan_key", "of_code", "modelo", "perfil", total.alias("bits"), agree.alias("agree"))


def rank_candidates(scored: DataFrame) -> DataFrame:
    by_row = Window.partitionBy("sheet_uid", "pos").orderBy(c("bits").desc(), c("agree").desc(), "plan_key")
    return scored.withColumn("rank", F.row_number().over(by_row))


def matches(ranked: DataFrame, n_plan: DataFrame, age_days: float = 0.0) -> DataFrame:
    """One row for each sheet row: winner, margin to the best of another order, mode, confidence.

    n_plan: one row, n. Confidence is a softmax of base 2 with the hypothesis that no line is meant.
    """
    everything = Window.partitionBy("sheet_uid", "pos")
    first = F.min_by("of_code", "rank").over(everything)
    prior = min(max(0.05 + 0.01 * age_days, 1e-4), 0.5)
    r = ranked.withColumn("win_of", first).withColumn("best", F.max("bits").over(everything)).crossJoin(F.broadcast(n_plan))  # one row
    h0 = F.lit(prior / (1 - prior)) * F.pow(F.lit(2.0), (S.H0_BITS + F.log2(F.greatest("n", F.lit(2))) - c("best") / 1e6) / S.TEMPERATURE)
    weight = F.pow(F.lit(2.0), (c("bits") - c("best")) / 1e6 / S.TEMPERATURE)
    r = r.withColumn("rival", F.max(F.when(c("of_code") != c("win_of"), c("bits"))).over(everything)).withColumn("mass", F.sum(weight).over(everything) + h0).withColumn("p", weight / c("mass"))
    margin = F.when(c("rival").isNull(), c("bits")).otherwise(c("bits") - c("rival"))
    mode = F.when((margin >= 4_000_000) & (c("bits") > 0), "strong").otherwise("weak")
    return r.where("rank = 1").select("sheet_uid", "pos", "plan_key", "bits", "agree", margin.alias("margin"), mode.alias("mode"), F.round("p", 9).alias("p"))


def link(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan, carried = settled(plan), settled(carry_down(rows))
    scored = score_pairs(carried, plan, candidates(carried, plan))
    return matches(rank_candidates(scored), plan.agg(F.count(F.lit(1)).alias("n")))


def link_all(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """link() with every sheet row: mode no_match, probability 0 and no line where nothing is found."""
    every = rows.select("sheet_uid", "pos").join(link(rows, plan), ["sheet_uid", "pos"], "left")
    none = c("mode").isNull()
    return every.select("sheet_uid", "pos", "plan_key", "bits", "agree", F.coalesce("margin", F.lit(0)).alias("margin"), F.coalesce("mode", F.lit("no_match")).alias("mode"), F.when(none, 0.0).otherwise(c("p")).alias("p"))

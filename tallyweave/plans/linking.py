"""Queries of candidates, evidence, windows and linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S
from tallyweave.operators import decode
from tallyweave.operators import dims as DM
from tallyweave.operators import linkage as L
from tallyweave.operators import ranking as R
from tallyweave.operators import sheets as H
from tallyweave.operators.lineage import settled

from .registry import Registry
from .scalar import CODE, COST, RATIO, WRITTEN, ZERO_O

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
c = F.col
KEY = ("sheet_uid", "pos")
OKEY = lambda s: f"regexp_replace({ZERO_O(s)}, '^0F', '')"
NOPRE = lambda s: f"regexp_replace(regexp_replace(upper({s}), '[^A-Z0-9]', '', 'g'), '^O[FV]', '')"

CARRY = f"""w0 AS (SELECT *, {WRITTEN('of_written')} AS o, {WRITTEN('ov_written')} AS v, {WRITTEN('perfil_written')} AS p, coalesce({WRITTEN('of_written')}, {WRITTEN('ov_written')}, {WRITTEN('perfil_written')}, {WRITTEN('modelo_written')}, {WRITTEN('qtd_written')}, {WRITTEN('perf_comp')}) IS NULL AS mute FROM sheet_rows),
w1 AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY sheet_uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w0),
w2 AS (SELECT *, sum(CASE WHEN mute OR (o IS NOT NULL AND (prev IS NULL OR NOT (({ZERO_O('o')}) = ({ZERO_O('prev')}) OR ({RATIO(CODE('o'), CODE('prev'))}) >= 0.9))) THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_uid ORDER BY pos) AS block FROM w1),
carried AS (SELECT *, CASE WHEN NOT mute THEN last_value(o IGNORE NULLS) OVER k END AS of_eff, CASE WHEN NOT mute THEN last_value(v IGNORE NULLS) OVER k END AS ov_eff, CASE WHEN NOT mute THEN last_value(p IGNORE NULLS) OVER k END AS perfil_eff,
  CASE WHEN NOT mute THEN last_value(CASE WHEN o IS NOT NULL THEN pos END IGNORE NULLS) OVER k END AS of_from FROM w2 WINDOW k AS (PARTITION BY sheet_uid, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_PK = lambda s: f"(CASE WHEN regexp_full_match({s}, '\\d+(X\\d+)*') THEN CASE WHEN len(string_split({s}, 'X')) = 2 THEN concat('L', split_part({s}, 'X', 1), 'X', {s}) ELSE 'L' || {s} END ELSE {s} END)"
_REST = "regexp_replace(upper(regexp_replace(perfil_eff, '\\s+', '', 'g')), '^L(\\d)', '\\1')"
#: Lines of a row's order where the plan has it; else the exact hits of each field, of values on at most 500 lines except orders.
CANDS = f"""pk AS (SELECT plan_key, {OKEY('of_code')} AS ko, regexp_replace({ZERO_O('ov')}, '^0V', '') AS kv, {OKEY('modelo')} AS km, perfil AS kp FROM plan_lines),
c1 AS (SELECT sheet_uid, pos, plan_key FROM carried JOIN pk ON {OKEY('of_eff')} = ko),
rest AS (SELECT k.* FROM carried k ANTI JOIN (SELECT DISTINCT ko FROM pk) o ON {OKEY('of_eff')} = o.ko),
fv AS (SELECT kv FROM pk GROUP BY kv HAVING count(*) <= 500), fm AS (SELECT km FROM pk GROUP BY km HAVING count(*) <= 500), fp AS (SELECT kp FROM pk GROUP BY kp HAVING count(*) <= 500),
c2 AS (SELECT sheet_uid, pos, plan_key FROM rest JOIN pk ON regexp_replace({ZERO_O('ov_eff')}, '^0[FV]', '') = kv SEMI JOIN fv ON fv.kv = pk.kv
  UNION SELECT sheet_uid, pos, plan_key FROM rest JOIN pk ON {OKEY('modelo_written')} = km SEMI JOIN fm ON fm.km = pk.km
  UNION SELECT sheet_uid, pos, plan_key FROM rest JOIN pk ON {_PK(_REST)} = kp SEMI JOIN fp ON fp.kp = pk.kp)"""
_W = lambda f: f"SELECT {f}, greatest(1.0, least(14.0, log2(0.6::DOUBLE / (count(*) / greatest((SELECT count(*) FROM plan_lines), 1000)::DOUBLE)))) AS w FROM plan_lines GROUP BY {f}"


def _field(name: str, written: str, field: str, code: bool) -> str:
    """Evidence of one field, on its distinct pairs of values."""
    x, y = (NOPRE(written), NOPRE(field)) if code else (_PK(_REST), field)
    same = f"{OKEY(written)} = {OKEY(field)}" if code else f"{x} = {y}"
    key = (lambda v: f"regexp_replace({ZERO_O(v)}, '^0[FV]', '')") if field == "ov" else OKEY
    known = f"EXISTS (SELECT 1 FROM (SELECT DISTINCT {key(field)} AS k FROM plan_lines) q WHERE q.k = {key(written)})" if code else "false"
    return f"""{name}0 AS (SELECT DISTINCT {written}, {field}, {x} AS x, {y} AS y, {same} AS same FROM base WHERE {written} IS NOT NULL),
{name}1 AS (SELECT *, CASE WHEN same THEN 1.0 ELSE {RATIO('x', 'y')} END AS sim, {known} AS known FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN sim < 0.9 THEN greatest(0.0, least(0.85, 1 - {COST('x', 'y')} / 12.0::DOUBLE)) ELSE 0.0 END AS g FROM {name}1),
{name} AS (SELECT {written}, {field}, CAST(round(CASE WHEN sim >= 1 THEN w WHEN sim >= 0.9 THEN w * 0.5 WHEN greatest(g, CASE WHEN sim >= 0.8 THEN 0.3 ELSE 0 END) > 0 THEN greatest(g, CASE WHEN sim >= 0.8 THEN 0.3 ELSE 0 END) * w WHEN known THEN -3.0 ELSE {-1.5 if code else -1.0} END * 1000000) AS BIGINT) AS bits,
  CAST(sim >= 0.55 AS INT) AS agree FROM {name}2 JOIN ({_W(field)}) USING ({field}))"""


FIELDS = (("eo", "of_eff", "of_code", True), ("ev", "ov_eff", "ov", True), ("ep", "perfil_eff", "perfil", False), ("em", "modelo_written", "modelo", True))
SCORED = "base AS (SELECT c1.sheet_uid, c1.pos, c1.plan_key, of_eff, ov_eff, perfil_eff, modelo_written, of_code, ov, perfil, modelo FROM c1 JOIN carried k ON c1.sheet_uid = k.sheet_uid AND c1.pos = k.pos JOIN plan_lines p ON c1.plan_key = p.plan_key), " + ",\n".join(_field(*f) for f in FIELDS)
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet_uid, pos ORDER BY bits DESC, agree DESC, plan_key) AS rank FROM pool)"
MATCHED = RANKED + """, m0 AS (SELECT *, arg_min(of_code, rank) OVER q AS win_of, max(bits) OVER q AS best, (SELECT count(*) FROM plan_lines) AS n FROM ranked WINDOW q AS (PARTITION BY sheet_uid, pos)),
m1 AS (SELECT *, max(CASE WHEN of_code <> win_of THEN bits END) OVER q AS rival, sum(pow(2.0, (bits - best) / 1e6 / 2.0)) OVER q + 0.05 / 0.95 * pow(2.0, (10.0 + log2(greatest(n, 2)) - best / 1e6) / 2.0) AS mass FROM m0 WINDOW q AS (PARTITION BY sheet_uid, pos)),
matched AS (SELECT sheet_uid, pos, plan_key, bits, agree, coalesce(bits - rival, bits) AS margin, CASE WHEN coalesce(bits - rival, bits) >= 4000000 AND bits > 0 THEN 'strong' ELSE 'weak' END AS mode, round(pow(2.0, (bits - best) / 1e6 / 2.0) / mass, 9) AS p FROM m1 WHERE rank = 1)"""


def ranked_of(t):
    return L.rank_candidates(t.pool)


def matched_of(t):
    return L.matches(ranked_of(t), n_plan(t))


def n_plan(t):
    return t.plan.agg(F.count(F.lit(1)).alias("n"))


def truth_of(t):
    return t.rows.select(*KEY, "true_plan_key")


def split_of(t):
    n = F.substr("sheet_uid", F.lit(3)).cast("long") % 3
    return t.rows.select(*KEY, F.when(n == 0, "dev").when(n == 1, "diagnostic").otherwise("held_out").alias("split"), "true_plan_key")


@query("link_rows")
def _(t):
    """No SQL: similar values of every field are searched; tests/test_whole_link.py holds it on small sheets."""
    return L.link_all(t.rows, t.plan)


@query("w1_ditto_fill", f"WITH {CARRY} SELECT sheet_uid, pos, of_eff, ov_eff, perfil_eff, of_from FROM carried")
def _(t):
    return L.carry_down(t.rows).select(*KEY, "of_eff", "ov_eff", "perfil_eff", "of_from")


@query("w2_effective_row", f"WITH {CARRY} SELECT sheet_uid, pos, coalesce(o, of_eff) AS of, coalesce(v, ov_eff) AS ov, coalesce(p, perfil_eff) AS perfil, coalesce(of_from <> pos, false) AS of_inherited FROM carried")
def _(t):
    return L.effective_rows(L.carry_down(t.rows)).select(*KEY, "of", "ov", "perfil", "of_inherited")


#: Every eleventh row of a sheet is for a hall of the house, every 17th cleaning, every 23rd deleted, every 29th waits for its identity.
_MARKS = "m AS (SELECT sheet_uid, pos, pos % 11 = 5 AS internal, CASE WHEN pos % 23 = 7 THEN 'deleted' WHEN pos % 29 = 9 THEN 'unresolved' WHEN coalesce(of_written, ov_written, perfil_written, modelo_written, perf_comp, qtd_written) IS NULL AND pos % 17 <> 3 AND pos % 11 <> 5 THEN 'empty' WHEN pos % 17 = 3 AND NOT coalesce(CASE WHEN qtd_written = '1.200' THEN 1200 ELSE TRY_CAST(qtd_written AS DOUBLE) END > 0, false) THEN 'activity' ELSE 'production' END AS kind FROM sheet_rows)"


@query("w3_segments", f"""WITH {_MARKS}, f AS (SELECT *, last_value(CASE WHEN kind NOT IN ('deleted', 'unresolved') THEN internal END IGNORE NULLS) OVER (PARTITION BY sheet_uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN kind <> 'deleted' AND (kind <> 'production' OR internal OR coalesce(before, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_uid ORDER BY pos) AS n FROM f)
SELECT sheet_uid, pos, kind, CASE WHEN kind = 'production' THEN concat(sheet_uid, '#', CAST(n AS VARCHAR)) END AS segment FROM n""")
def _(t):
    marked = t.rows.withColumns({"cliente_written": F.when(c("pos") % 11 == 5, "Pavilhão 2").when(c("pos") % 17 == 3, "limpeza"), "deleted": c("pos") % 23 == 7, "unresolved": c("pos") % 29 == 9})
    return H.segments(H.row_kinds(marked)).select(*KEY, "kind", "segment")


@query("w4_rank_candidates", f"WITH {RANKED} SELECT sheet_uid, pos, plan_key, bits, agree, rank FROM ranked")
def _(t):
    return ranked_of(t).select(*KEY, "plan_key", "bits", "agree", "rank")


@query("w5_margin_bits", f"WITH {MATCHED} SELECT sheet_uid, pos, plan_key, margin FROM matched")
def _(t):
    return matched_of(t).select(*KEY, "plan_key", "margin")


@query("w6_rivals", f"WITH {RANKED}, b AS (SELECT *, max(bits) OVER (PARTITION BY sheet_uid, pos) AS best FROM ranked) SELECT sheet_uid, pos, plan_key, rank FROM b WHERE rank BETWEEN 2 AND 6 AND best - bits <= 2000000")
def _(t):
    best = F.max("bits").over(Window.partitionBy(*KEY))
    return ranked_of(t).withColumn("best", best).where(c("rank").between(2, 6) & (c("best") - c("bits") <= 2_000_000)).select(*KEY, "plan_key", "rank")


@query("w7_posterior", f"WITH {MATCHED} SELECT sheet_uid, pos, p FROM matched")
def _(t):
    return matched_of(t).select(*KEY, "p")


@query("w8_marginals", f"WITH b AS (SELECT *, max(bits) OVER (PARTITION BY sheet_uid, pos) AS best FROM pool), g AS (SELECT sheet_uid, pos, of_code, any_value(best) AS best, sum(pow(2.0, (bits - best) / 1e6 / 2.0)) AS m FROM b GROUP BY sheet_uid, pos, of_code) SELECT sheet_uid, pos, of_code, round(m / (sum(m) OVER (PARTITION BY sheet_uid, pos) + 0.05 / 0.95 * pow(2.0, (10.0 + log2((SELECT count(*) FROM plan_lines)) - best / 1e6) / 2.0)), 9) AS share FROM g")
def _(t):
    row = Window.partitionBy(*KEY)
    mass = F.pow(F.lit(2.0), (c("bits") - c("best")) / 1e6 / S.TEMPERATURE)
    g = t.pool.withColumn("best", F.max("bits").over(row)).groupBy(*KEY, "of_code").agg(F.any_value("best").alias("best"), F.sum(mass).alias("m")).crossJoin(F.broadcast(n_plan(t)))  # one row
    return g.select(*KEY, "of_code", F.round(c("m") / (F.sum("m").over(row) + R.no_line_mass(c("best"), c("n"), S.TEMPERATURE)), 9).alias("share"))


@query("w9_match_mode", f"WITH {MATCHED} SELECT sheet_uid, pos, mode FROM matched")
def _(t):
    return matched_of(t).select(*KEY, "mode")


@query("w10_state_prune", f"WITH {RANKED} SELECT sheet_uid, pos, of_code, perfil, arg_min(plan_key, rank) AS plan_key FROM ranked GROUP BY ALL")
def _(t):
    return ranked_of(t).groupBy(*KEY, "of_code", "perfil").agg(F.min_by("plan_key", "rank").alias("plan_key"))


@query("w11_decode_sequence")
def _(t):
    """No SQL: the best path over the states of each segment; tests/test_decode.py holds it against all paths."""
    _, lines, pool, cards = sheet_pool(t)
    found = decode.decode_all(H.states_of(pool, lines)).select("segment", "pos", "of", "perfil", "continuity")
    return H.valued(found, cards)


@query("w12_max_marginals")
def _(t):
    """No SQL, as w11: micro-bits that the best path through each state lacks to the best of all."""
    _, lines, pool, cards = sheet_pool(t)
    found = decode.decode_all(H.states_of(pool, lines)).select("segment", "pos", F.explode("supports").alias("s"))
    return H.valued(found.select("segment", "pos", "s.of", "s.perfil", "s.support"), cards)


@query("w13_tiebreak_reason", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY sheet_uid, pos ORDER BY bits DESC, open DESC, plan_key) AS rank, count(*) OVER s AS n, NOT bool_and(open) OVER s AS some_closed FROM pool WINDOW s AS (PARTITION BY sheet_uid, pos, bits)) SELECT sheet_uid, pos, plan_key, CASE WHEN n = 1 THEN 'direct_evidence' WHEN open AND some_closed THEN 'current_positive_remaining' ELSE 'semantic_key' END AS reason FROM r WHERE rank = 1")
def _(t):
    return R.tie_reason(t.pool)


@query("w14_low_evidence", f"WITH {MATCHED} SELECT sheet_uid, pos, agree < 2 OR bits <= 0 AS low FROM matched")
def _(t):
    return matched_of(t).select(*KEY, ((c("agree") < 2) | (c("bits") <= 0)).alias("low"))


@query("w15_review_order", f"WITH {MATCHED} SELECT sheet_uid, pos, row_number() OVER (PARTITION BY sheet_uid ORDER BY round(3 * (1 - p), 6) DESC, pos) AS review FROM matched WHERE mode = 'weak'")
def _(t):
    need = F.round(3 * (1 - c("p")), 6)
    return matched_of(t).where("mode = 'weak'").select(*KEY, F.row_number().over(Window.partitionBy("sheet_uid").orderBy(need.desc(), "pos")).alias("review"))


@query("w16_alternatives", f"WITH {RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY sheet_uid, pos, of_code ORDER BY rank) AS k FROM ranked), b AS (SELECT *, row_number() OVER (PARTITION BY sheet_uid, pos ORDER BY rank) AS alt FROM a WHERE k = 1) SELECT sheet_uid, pos, of_code, alt FROM b WHERE alt <= 5")
def _(t):
    one = ranked_of(t).withColumn("k", F.row_number().over(Window.partitionBy(*KEY, "of_code").orderBy("rank"))).where("k = 1")
    return one.withColumn("alt", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank"))).where("alt <= 5").select(*KEY, "of_code", "alt")


@query("w17_last_value_per_cell", "SELECT sheet_uid, field_path, arg_max(new_value, id) AS v, max(id) AS id FROM edits GROUP BY ALL")
def _(t):
    return t.edits.groupBy("sheet_uid", "field_path").agg(F.max_by("new_value", "id").alias("v"), F.max("id").alias("id"))


@query("j1_exact_candidates", f"SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN plan_lines ON {OKEY('of_written')} = {OKEY('of_code')}")
def _(t):
    return L.exact_candidates(t.rows, t.plan, "of_written", "of_code")


@query("j2_exact_candidates_capped", f"WITH k AS (SELECT {OKEY('modelo')} AS k, plan_key FROM plan_lines) SELECT sheet_uid, pos, plan_key FROM sheet_rows JOIN k ON {OKEY('modelo_written')} = k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) <= 500)")
def _(t):
    return L.exact_candidates(t.rows, t.plan, "modelo_written", "modelo", L.CAP)


@query("j3_of_anchor_candidates", f"WITH {CARRY}, {CANDS} SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def _(t):
    return L.anchored_candidates(settled(L.carry_down(t.rows)), t.plan)


@query("j4_fuzzy_topk", f"""WITH w AS (SELECT DISTINCT upper(modelo_written) AS w FROM sheet_rows WHERE modelo_written IS NOT NULL), v AS (SELECT DISTINCT modelo AS v FROM plan_lines),
n AS (SELECT w, v, {RATIO('w', 'v')} AS sim FROM w JOIN v ON length(v) BETWEEN length(w) - 3 AND length(w) + 3 WHERE {RATIO('w', 'v')} >= 0.6), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY sim DESC, v DESC) AS rank FROM n) SELECT * FROM r WHERE rank <= 10""")
def _(t):
    return L.fuzzy_top(t.rows.where("modelo_written is not null").select(F.upper("modelo_written").alias("w")).distinct(), t.plan.select(c("modelo").alias("v")).distinct())


@query("j5_tolerance_join", "SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON b.p_retailprice BETWEEN a.p_retailprice - 1.6 AND a.p_retailprice + 1.6 WHERE abs(a.p_retailprice - b.p_retailprice) <= 1.5")
def _(t):
    p = t.base("part")
    return L.tolerance_join(p.select("p_partkey", c("p_retailprice").alias("x")), p.select(c("p_partkey").alias("other"), c("p_retailprice").alias("y")), "x", "y", 1.5).select("p_partkey", "other")


_DIM_ROWS = "r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS a, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS b FROM part), l AS (SELECT p_partkey AS other, CAST(p_size AS DOUBLE) AS a, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS b FROM part)"
DIMS = {"a": 1.0, "b": 20.0}


def dim_sides(t):
    """Parts that lack their size, their price or both, against parts of which some lack the price."""
    d = t.base("part").select("p_partkey", c("p_size").cast("double").alias("a"), c("p_retailprice").cast("double").alias("b"))
    rows = d.select("p_partkey", F.when(c("p_partkey") % 5 != 0, c("a")).alias("a"), F.when(c("p_partkey") % 7 != 0, c("b")).alias("b"))
    return rows, d.select(c("p_partkey").alias("other"), "a", F.when(c("p_partkey") % 11 != 0, c("b")).alias("b"))


@query("j6_dims_intersection", f"""WITH {_DIM_ROWS}, i AS (SELECT r.p_partkey, l.other FROM r JOIN l ON r.b IS NULL AND l.a BETWEEN r.a - 1 AND r.a + 1
  UNION ALL SELECT r.p_partkey, l.other FROM r JOIN l ON r.b IS NOT NULL AND l.b BETWEEN r.b - 20.1 AND r.b + 20.1 WHERE abs(r.b - l.b) <= 20.0 AND (r.a IS NULL OR abs(r.a - l.a) <= 1))
SELECT p_partkey, other FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY other) AS k FROM i) WHERE k <= 500""")
def _(t):
    rows, lines = dim_sides(t)
    return DM.candidates(rows, lines, "p_partkey", "other", DIMS)


@query("e9_joint_counts", f"""WITH {_DIM_ROWS}, k AS (SELECT DISTINCT a, b FROM r), la AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT k.a, k.b, 1 AS mask, CAST(sum(n) AS BIGINT) AS joint FROM k JOIN la ON abs(k.a - la.a) <= 1 GROUP BY k.a, k.b
UNION ALL SELECT k.a, k.b, 2, count(*) FROM k JOIN l ON l.b BETWEEN k.b - 20.1 AND k.b + 20.1 WHERE abs(k.b - l.b) <= 20 GROUP BY k.a, k.b
UNION ALL SELECT k.a, k.b, 3, count(*) FROM k JOIN l ON l.b BETWEEN k.b - 20.1 AND k.b + 20.1 WHERE abs(k.b - l.b) <= 20 AND abs(k.a - l.a) <= 1 GROUP BY k.a, k.b""")
def _(t):
    """How many lines agree in the size, the price, or both, of each row's dimensions."""
    return DM.joint_counts(*dim_sides(t), DIMS)


@query("j7_uncapped_retry", f"""WITH {CARRY}, {CANDS}, none AS (SELECT r.* FROM rest r ANTI JOIN c2 ON r.sheet_uid = c2.sheet_uid AND r.pos = c2.pos)
SELECT sheet_uid, pos, plan_key FROM none JOIN pk ON regexp_replace({ZERO_O('ov_eff')}, '^0[FV]', '') = kv UNION SELECT sheet_uid, pos, plan_key FROM none JOIN pk ON {OKEY('modelo_written')} = km UNION SELECT sheet_uid, pos, plan_key FROM none JOIN pk ON {_PK(_REST)} = kp""")
def _(t):
    """Rows that find nothing under the cap take all lines of their values."""
    return L.uncapped_candidates(settled(L.carry_down(t.rows)), t.plan)


_POOLS: dict[tuple, tuple] = {}
_CHOICES: dict[tuple, DataFrame] = {}


def sheet_pool(t):
    """The row kinds, rows, pool and plan of the second engine, worked out once for all queries of a session that show a part of it."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _POOLS:
        kinds, cards = settled(H.row_kinds(t.rows)), H.plan_cards(t.plan)
        lines = settled(H.sheet_lines(kinds))
        _POOLS[key] = kinds, lines, H.candidate_pool(lines, cards), cards
    return _POOLS[key]


def sheet_choices(t):
    """The second engine's choices, worked out once like sheet_pool()."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _CHOICES:
        kinds, lines, pool, _ = sheet_pool(t)
        _CHOICES[key] = H.choices(kinds, lines, pool)
    return _CHOICES[key]


@query("j8_candidate_union")
def _(t):
    """No SQL: equal and similar values of all fields, by bounds; tests/test_sheets.py holds it against all pairs."""
    return sheet_pool(t)[2].select(*KEY, "plan_key", "score", "fallback")


@query("link_sheets")
def _(t):
    """No SQL: the second engine from rows to choices; tests/test_sheets.py holds it against plain loops."""
    return sheet_choices(t)


@query("link_sheets_modes")
def _(t):
    """No SQL, as link_sheets: how often each mode of the second engine is right; tests/test_sheets.py counts one by one."""
    return R.mode_report(sheet_choices(t), truth_of(t))


@query("link_sheets_metrics")
def _(t):
    """No SQL, as link_sheets: orders, models, profiles, recall of its own pool and confidence, by split."""
    return R.linkage_metrics(sheet_choices(t), sheet_pool(t)[2], split_of(t), t.plan)


@query("j9_anchor_expand", f"WITH {CARRY}, a AS (SELECT DISTINCT sheet_uid, {OKEY('of_eff')} AS k FROM carried WHERE of_eff IS NOT NULL) SELECT a.sheet_uid, plan_key FROM a JOIN plan_lines ON a.k = {OKEY('of_code')}")
def _(t):
    anchors = L.carry_down(t.rows).where("of_eff is not null").select("sheet_uid", L.order_key(c("of_eff")).alias("k")).distinct()
    return anchors.join(t.plan.select(L.order_key(c("of_code")).alias("k"), "plan_key"), "k").select("sheet_uid", "plan_key")


@query("j10_score_pairs", f"WITH {CARRY}, {CANDS}, {SCORED} SELECT b.sheet_uid, b.pos, b.plan_key, coalesce(eo.bits, 0) + coalesce(ev.bits, 0) + coalesce(ep.bits, 0) + coalesce(em.bits, 0) AS bits FROM base b LEFT JOIN eo USING (of_eff, of_code) LEFT JOIN ev USING (ov_eff, ov) LEFT JOIN ep USING (perfil_eff, perfil) LEFT JOIN em USING (modelo_written, modelo)")
def _(t):
    """Rows against the lines of their order: look-alikes, veto and all."""
    t.settle("plan_lines")
    return L.score_by_order(settled(L.carry_down(t.rows)), t.plan).select(*KEY, "plan_key", "bits")


@query("j11_exists_in_plan", f"WITH k AS (SELECT DISTINCT {OKEY('of_code')} AS k FROM plan_lines) SELECT sheet_uid, pos, k.k IS NOT NULL AS known FROM sheet_rows LEFT JOIN k ON {OKEY('of_written')} = k.k")
def _(t):
    known = t.plan.select(L.order_key(c("of_code")).alias("k")).distinct()
    return t.rows.join(known, L.order_key(c("of_written")) == c("k"), "left").select(*KEY, c("k").isNotNull().alias("known"))


@query("j12_pair_lookup", f"WITH {CARRY} SELECT sheet_uid, pos, plan_key FROM carried JOIN plan_lines ON {OKEY('of_eff')} = {OKEY('of_code')} AND modelo_written = modelo")
def _(t):
    p = t.plan.select("plan_key", L.order_key(c("of_code")).alias("k"), "modelo")
    r = L.carry_down(t.rows).select(*KEY, L.order_key(c("of_eff")).alias("k"), c("modelo_written").alias("modelo"))
    return r.join(p, ["k", "modelo"]).select(*KEY, "plan_key")


@query("a18_measure_m", f"""WITH x AS (SELECT r.*, p.of_code, p.ov, p.modelo FROM sheet_rows r JOIN plan_lines p ON r.true_plan_key = p.plan_key),
f AS (SELECT 'of' AS field, CASE WHEN ({ZERO_O('of_written')}) = regexp_replace({ZERO_O('of_code')}, '^0F', '') THEN 1.0 ELSE {RATIO(CODE('of_written'), CODE('of_code'))} END AS sim FROM x WHERE of_written IS NOT NULL AND of_written <> '"'
  UNION ALL SELECT 'ov', CASE WHEN ({ZERO_O('ov_written')}) = regexp_replace({ZERO_O('ov')}, '^0V', '') THEN 1.0 ELSE {RATIO(CODE('ov_written'), CODE('ov'))} END FROM x WHERE ov_written IS NOT NULL
  UNION ALL SELECT 'modelo', CASE WHEN ({ZERO_O('modelo_written')}) = ({ZERO_O('modelo')}) THEN 1.0 ELSE {RATIO(CODE('modelo_written'), CODE('modelo'))} END FROM x WHERE modelo_written IS NOT NULL)
SELECT field, round(CAST(sum(CASE WHEN sim >= 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS m, count(*) AS total FROM f GROUP BY field HAVING count(*) >= 30""")
def _(t):
    return L.measure_m(t.rows, t.plan)


@query("a19_scenario_report", f"WITH {MATCHED} SELECT m.mode, count(*) AS n, CAST(sum(CASE WHEN m.plan_key = r.true_plan_key THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM sheet_rows r JOIN matched m ON r.sheet_uid = m.sheet_uid AND r.pos = m.pos GROUP BY m.mode")
def _(t):
    m = matched_of(t).join(truth_of(t), list(KEY))
    return m.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(c("plan_key") == c("true_plan_key"), F.lit(False)).cast("long")).alias("correct"))


@query("a20_brier", """WITH r AS (SELECT *, max(bits) OVER (PARTITION BY sheet_uid, pos) AS best, row_number() OVER (PARTITION BY sheet_uid, pos ORDER BY bits DESC, agree DESC, plan_key) AS rank FROM pool), temps AS (SELECT CAST(unnest([1.0, 1.5, 2.0, 2.5, 3.0, 4.0]) AS DOUBLE) AS temperature),
g AS (SELECT sheet_uid, pos, temperature, max(CASE WHEN rank = 1 AND plan_key = true_plan_key THEN 1 ELSE 0 END) AS correct, 1 / (sum(pow(2.0, (bits - best) / 1e6 / temperature)) + 0.05 / 0.95 * pow(2.0, (10.0 + log2((SELECT count(*) FROM plan_lines)) - any_value(best) / 1e6) / temperature)) AS p FROM r, temps GROUP BY sheet_uid, pos, temperature)
SELECT temperature, round(avg(pow(p - correct, 2)), 6) AS brier FROM g GROUP BY temperature""")
def _(t):
    return R.brier(R.posterior_by_temperature(t.pool, n_plan(t)), truth_of(t))


@query("a21_linkage_metrics", f"""WITH {MATCHED}, t AS (SELECT sheet_uid, pos, CASE CAST(substr(sheet_uid, 3) AS BIGINT) % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'diagnostic' ELSE 'held_out' END AS split, true_plan_key FROM sheet_rows),
x AS (SELECT t.split, e.of_code = w.of_code AS o, e.modelo = w.modelo AS m, e.perfil = w.perfil AS f, EXISTS (SELECT 1 FROM pool q WHERE q.sheet_uid = t.sheet_uid AND q.pos = t.pos AND q.plan_key = t.true_plan_key) AS held, p FROM t JOIN plan_lines e ON e.plan_key = t.true_plan_key LEFT JOIN matched k ON k.sheet_uid = t.sheet_uid AND k.pos = t.pos LEFT JOIN plan_lines w ON w.plan_key = k.plan_key)
SELECT split, count(*) AS eligible, count_if(o) AS right_of, count_if(m) AS right_modelo, count_if(o AND m) AS right_pair, count_if(f) AS right_perfil, count_if(held) AS recalled, round(min(p), 6) AS p_min, round(avg(p), 6) AS p_mean, round(max(p), 6) AS p_max, count_if(p >= 0.95) AS sure FROM x GROUP BY split""")
def _(t):
    t.settle("plan_lines")
    true = t.pool.where("plan_key = true_plan_key").drop("true_plan_key")  # other pairs can recall nothing
    return R.linkage_metrics(matched_of(t), true, split_of(t), t.plan)


@query("a22_coverage_rate", f"WITH k AS (SELECT DISTINCT {OKEY('of_code')} AS k FROM plan_lines) SELECT round(avg(CASE WHEN k.k IS NULL THEN 0.0 ELSE 1.0 END), 6) AS rate FROM sheet_rows LEFT JOIN k ON {OKEY('of_written')} = k.k WHERE of_written IS NOT NULL")
def _(t):
    known = t.plan.select(L.order_key(c("of_code")).alias("k")).distinct()
    return t.rows.where("of_written is not null").join(known, L.order_key(c("of_written")) == c("k"), "left").agg(F.round(F.avg(c("k").isNotNull().cast("double")), 6).alias("rate"))


_ABSENT = "CAST(substr(snapshot_id, 2) AS BIGINT) % 5 = 0"


@query("a23_exclusion_report", f"WITH s AS (SELECT plan_key, of_code FROM plan_lines WHERE NOT ({_ABSENT})) SELECT r.sheet_uid, count(*) AS labels, count_if(s.plan_key IS NULL) AS missing_lines, count_if(p.of_code NOT IN (SELECT of_code FROM s)) AS missing_orders FROM sheet_rows r JOIN plan_lines p ON p.plan_key = r.true_plan_key LEFT JOIN s ON s.plan_key = r.true_plan_key GROUP BY r.sheet_uid")
def _(t):
    """What labels a snapshot without every fifth month cannot hold."""
    labels = truth_of(t).join(t.plan.select(c("plan_key").alias("true_plan_key"), "of_code"), "true_plan_key")
    return L.exclusions(labels, t.plan.where(f"not ({_ABSENT})"))


@query("a25_confidence", """WITH v AS (SELECT sheet_uid, pos, unnest(['of_code', 'perfil', 'modelo']) AS field, unnest([of_code, perfil, modelo]) AS value, bits FROM pool), b AS (SELECT sheet_uid, pos, field, value, max(bits) AS bits FROM v GROUP BY ALL),
h AS (SELECT *, greatest(max(bits) OVER (PARTITION BY sheet_uid, pos, field), 10000000) AS high FROM b)
SELECT sheet_uid, pos, field, value, round(pow(2.0, (bits - high) / 1e6 / 2.0) / (sum(pow(2.0, (bits - high) / 1e6 / 2.0)) OVER (PARTITION BY sheet_uid, pos, field) + pow(2.0, (10000000 - high) / 1e6 / 2.0)), 9) AS confidence FROM h""")
def _(t):
    return R.support_by_value(t.pool)


@query("j27_label_join", f"""WITH {MATCHED} SELECT r.sheet_uid, r.pos, s.plan_key IS NOT NULL AS evaluable, CASE WHEN s.plan_key IS NOT NULL THEN coalesce(m.plan_key = r.true_plan_key, false) END AS right_line
FROM sheet_rows r LEFT JOIN matched m ON m.sheet_uid = r.sheet_uid AND m.pos = r.pos LEFT JOIN (SELECT plan_key FROM plan_lines WHERE NOT ({_ABSENT})) s ON s.plan_key = r.true_plan_key""")
def _(t):
    return L.label_join(matched_of(t), truth_of(t), t.plan.where(f"not ({_ABSENT})"))


@query("g7_glyph_noise", """WITH x AS (SELECT plan_key, modelo, cliente, CAST(split_part(plan_key, ':', 2) AS BIGINT) AS n FROM plan_lines), y AS (SELECT *, CAST(n % length(modelo) AS INT) + 1 AS i FROM x)
SELECT plan_key, CASE n % 3 WHEN 0 THEN substr(modelo, 1, i - 1) || substr(modelo, i + 1) WHEN 1 THEN substr(modelo, 1, i - 1) || translate(substr(modelo, i, 1), '05186249A3', 'OSIBGZAG48') || substr(modelo, i + 1) ELSE modelo END AS modelo, CASE WHEN n % 4 = 0 THEN substr(cliente, 1, 9) ELSE cliente END AS cliente FROM y""")
def _(t):
    return L.glyph_noise(t.plan.select("plan_key", "modelo", "cliente", F.split_part("plan_key", F.lit(":"), F.lit(2)).cast("long").alias("n"))).select("plan_key", "modelo", "cliente")

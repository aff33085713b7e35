"""Columns that measure how well a written value agrees with a plan value, in shares and in bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import normalize as N

#: Fixed values of the scorer: m, bounds of a weight, factors and penalties, in bits.
M_DEFAULT, W_LEAST, W_MOST = 0.60, 1.0, 14.0
NEAR, NEAR_FACTOR, VETO, DISAGREE_CODE, DISAGREE_TEXT = 0.90, 0.5, -3.0, -1.5, -1.0
SIMILAR, SIMILAR_FLOOR = 0.80, 0.30
H0_BITS, TEMPERATURE = 10.0, 2.0
#: Characters that are mistaken for one another in handwriting, and costs in bits.
GLYPH_PAIRS = ("0O", "0Q", "0D", "1I", "1L", "17", "5S", "8B", "6G", "2Z", "9G", "4A", "MH", "EF", "UV", "KR", "CG", "38")
COST_OTHER, COST_GLYPH, COST_INDEL, COST_SCALE, COST_CAP = 8, 2, 5, 12.0, 0.85


def ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def code_similarity(a: Column, b: Column) -> Column:
    x, y = N.normalize_code(a), N.normalize_code(b)
    blank = F.coalesce(x, F.lit("")).isin("") | F.coalesce(y, F.lit("")).isin("")
    return F.when(blank, 0.0).when(N.zero_o_key(a) == N.zero_o_key(b), 1.0).otherwise(ratio(x, y))


def text_similarity(a: Column, b: Column) -> Column:
    x, y, s, t = N.compact(a), N.compact(b), N.client_tokens(a), N.client_tokens(b)
    common = F.size(F.array_intersect(s, t))
    best = F.array_max(F.flatten(F.transform(s, lambda u: F.transform(F.slice(t, 1, 8), lambda v: ratio(u, v)))))
    blank = (F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == "")
    return F.when(blank, 0.0).when(x == y, 1.0).when((F.length(x) >= 4) & (y.contains(x) | x.contains(y)), 0.97).when(common > 0, F.least(F.lit(0.97), 0.6 + 0.2 * common)).otherwise(F.greatest(F.coalesce(best, F.lit(0.0)), ratio(x, y)))


def numeric_similarity(a: Column, b: Column, tolerance: float) -> Column:
    gap = F.abs(a - b)
    return F.when(gap.isNull(), 0.0).when(gap <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (gap - tolerance) / max(3 * tolerance, 1e-9)))


def value_weight(freq: Column, n: Column, m: float = M_DEFAULT) -> Column:
    """Bits that an agreement is worth: more for rare values."""
    u = F.greatest(freq, F.lit(1)) / F.greatest(n, F.lit(1000))
    return F.greatest(F.lit(W_LEAST), F.least(F.lit(W_MOST), F.log2(F.lit(m) / u)))


def micro_bits(bits: Column) -> Column:
    """Whole millionths of a bit: sums then don't depend on their order."""
    return F.round(bits * 1_000_000).cast("long")


def align_cost(a: Column, b: Column) -> Column:
    """Cost in bits of the cheapest alignment: 2 for look-alikes, 8 for other changes, 5 for a missing character.

    One pass over a's characters that carries a row of costs over b's, as nested aggregates.
    """
    left, right = F.filter(F.split(F.upper(a), ""), lambda c: c != ""), F.filter(F.split(F.upper(b), ""), lambda c: c != "")
    alike = F.array(*(F.lit(p) for x in GLYPH_PAIRS for p in (x, x[::-1])))
    change = lambda x, y: F.when(x == y, 0).when(F.array_contains(alike, F.concat(x, y)), COST_GLYPH).otherwise(COST_OTHER)
    first = F.transform(F.sequence(F.lit(0), F.size(right)), lambda i: i * COST_INDEL)

    def step(row: Column, x: Column) -> Column:
        start = F.array(row[0] + COST_INDEL)
        add = lambda acc, j: F.concat(acc, F.array(F.least(F.get(row, j) + COST_INDEL, F.element_at(acc, -1) + COST_INDEL, F.get(row, j - 1) + change(x, F.get(right, j - 1)))))
        return F.when(F.size(right) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(right), F.lit(1))), start, add))

    return F.element_at(F.aggregate(left, first, step), -1)


_CHANGE = np.full((128, 128), COST_OTHER, np.int64)
for _x, _y in GLYPH_PAIRS:
    _CHANGE[ord(_x), ord(_y)] = _CHANGE[ord(_y), ord(_x)] = COST_GLYPH
#: Cells of a row of costs that are held at once, over all pairs of a block.
CELLS = 1 << 20


def align_costs(a: list[str], b: list[str]) -> np.ndarray:
    """align_cost of many pairs at once: a step takes one more character of every a, against all of its b."""
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.empty(len(a), np.int64)
    size = np.maximum(np.ceil(np.log2(np.maximum(n, m) + 1)).astype(np.int64), 4)
    for k in np.unique(size):  # a block holds pairs of like lengths, so that a long one widens no others
        members, step = np.flatnonzero(size == k), max(1, CELLS >> k)
        for start in range(0, len(members), step):
            block = members[start : start + step]
            out[block] = _block_costs([a[i] for i in block], [b[i] for i in block], n[block], m[block])
    return out


def _block_costs(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    points = lambda xs, width: np.array(xs, f"U{max(width, 1)}").view(np.uint32).reshape(len(xs), -1).astype(np.int64)
    left, right = points(a, n.max()), points(b, m.max())
    known = np.minimum(right, 127)
    insert = COST_INDEL * np.arange(right.shape[1] + 1)
    row = np.broadcast_to(insert, (len(a), len(insert))).copy()
    out = np.where(n == 0, COST_INDEL * m, 0)
    for i in range(int(n.max())):
        x = left[:, i : i + 1]
        change = np.where(x == right, 0, _CHANGE[np.minimum(x, 127), known])
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + COST_INDEL
        new[:, 1:] = np.minimum(row[:, :-1] + change, row[:, 1:] + COST_INDEL)
        row = np.minimum.accumulate(new - insert, axis=1) + insert  # insertions along the row
        done = n == i + 1
        out[done] = row[done, m[done]]
    return out


def _aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if both.any():
        out[both] = align_costs(a[both].tolist(), b[both].tolist())
    return pd.Series(out).astype("Int64")


def align_cost_vector(a: Column, b: Column) -> Column:
    """align_cost in Arrow batches, far cheaper for millions of pairs; null where a or b is."""
    return F.pandas_udf(_aligned, LongType())(F.upper(a), F.upper(b))


def channel_evidence(cost: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(COST_CAP), 1 - cost / COST_SCALE))


def _classes() -> tuple[str, str]:
    """Each character that is mistaken for another, and one that stands for all that it is linked with."""
    leader: dict[str, str] = {}
    for pair in GLYPH_PAIRS:
        a, b = (leader.setdefault(x, x) for x in pair)
        leader = {x: min(a, b) if y in (a, b) else y for x, y in leader.items()}
    return "".join(leader), "".join(leader.values())


def look_alike_form(s: Column) -> Column:
    """Equal for texts that differ in look-alikes only."""
    return F.translate(F.upper(s), *_classes())


def _may_align(a: Column, b: Column, form_a: Column, form_b: Column) -> Column:
    """False only if the alignment costs 12 or more. Two edits besides look-alikes cost less only if both are missing
    characters and nothing else differs."""
    edits = F.levenshtein(form_a, form_b, 2)
    return F.when(edits < 0, False).when(edits < 2, True).otherwise(F.levenshtein(F.upper(a), F.upper(b), 2) >= 0)


def _even_cost(a: Column, b: Column) -> Column:
    """align_cost of upper-case texts of one length where that is below 12, else 12 or more.

    Such an alignment changes characters in their places, or takes one out and puts one in: between the first and the last
    place that differ one text is then the other, moved by one.
    """
    at = lambda s, i, n=1: s.substr(i, F.lit(n) if isinstance(n, int) else n)
    alike = F.array(*(F.lit(p) for x in GLYPH_PAIRS for p in (x, x[::-1])))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: at(a, i) != at(b, i))
    change = lambda i: F.when(F.array_contains(alike, F.concat(at(a, i), at(b, i))), COST_GLYPH).otherwise(COST_OTHER)

    def cost(m: Column) -> Column:
        first, gap = F.get(m, F.lit(0)), F.element_at(m, -1) - F.get(m, F.lit(0))
        moved = (at(a, first + 1, gap) == at(b, first, gap)) | (at(b, first + 1, gap) == at(a, first, gap))
        changed = F.aggregate(F.slice(m, 1, 6), F.lit(0), lambda n, i: n + change(i))  # six changes cost 12
        return F.when(F.size(m) == 0, 0).otherwise(F.when(moved, F.least(changed, F.lit(2 * COST_INDEL))).otherwise(changed))

    return N.once(differ, cost)


def near_look_alike(a: Column, b: Column, form_a: Column, form_b: Column) -> Column:
    """look_alike_evidence() of texts with their look_alike_form: few pairs are aligned, one by one, and none is sent to Python."""
    cost = F.when(F.length(a) == F.length(b), _even_cost(F.upper(a), F.upper(b))).otherwise(align_cost(a, b))
    return F.when(_may_align(a, b, form_a, form_b), channel_evidence(cost.cast("double"))).otherwise(0.0)


def look_alike_evidence(a: Column, b: Column) -> Column:
    """channel_evidence of the alignment. It is 0 from 12 bits on, and an edit that isn't a look-alike costs 5 at least: so
    no alignment is needed where more than two edits remain once look-alikes are taken for equal."""
    form = lambda x: F.translate(F.upper(x), *_classes())
    cost = align_cost_vector(F.when(F.levenshtein(form(a), form(b), 2) >= 0, a), b)
    return F.when(cost.isNotNull(), channel_evidence(cost.cast("double"))).otherwise(0.0)


def channel_floor(similarity: Column, channel: Column) -> Column:
    """Channel evidence of a field, which is never nothing where values are similar, whatever their alignment costs."""
    return F.when(similarity >= SIMILAR, F.greatest(channel, F.lit(SIMILAR_FLOOR))).otherwise(channel)


def identity_bits(similarity: Column, channel: Column, weight: Column, known: Column, blank: Column, code: bool = True) -> Column:
    """Evidence of one field: exact, near, look-alike (channel with its floor), written value known elsewhere (veto), or
    disagreement."""
    miss = DISAGREE_CODE if code else DISAGREE_TEXT
    return F.when(blank, 0.0).when(similarity >= 1, weight).when(similarity >= NEAR, weight * NEAR_FACTOR).when(channel > 0, channel * weight).when(known, VETO).otherwise(miss)


#: Fixed values of the second scorer, in bits.
CODE_WEIGHTS = (("of", 12.0), ("ov", 7.0), ("modelo", 10.0))
LENGTH_BITS, SPLIT_COST, MATERIAL_SAME, MATERIAL_OTHER = 6.0, 6.5, 2.0, -4.0
#: Bits of dimensions that agree or not.
DIM_FLOOR, DIM_CAP, DIM_DISAGREE, DIM_DISAGREE_CAP = 0.1, 12.0, -2.5, -5.0


def profile_score(w: Column, t: Column, material: Column | None = None) -> Column:
    """Bits of a written profile against a plan's, both parsed; material may name the plan's family where it has none."""
    dims, truth = w["dims"], t["dims"]
    family = F.when(t["family"] == "", N.family_for_material(material)).otherwise(t["family"]) if material is not None else t["family"]
    n, m = F.size(dims), F.size(truth)
    within = lambda least, first=None: F.forall(
        F.sequence(F.lit(0), F.least(n, m) - 1),
        lambda i: F.abs(F.get(dims, i) - F.get(truth, i)) <= F.greatest(F.when(i == 0, F.lit(first or least)).otherwise(F.lit(least)), F.abs(F.get(truth, i)) * F.lit(0.01) if least != 0.001 else F.lit(0.0)),
    )
    sized = F.when(within(0.001) & (n == m), 10.0).when(within(0.001) & (n < m), 7.0).when((n < m) & within(0.05, 0.5), 6.0).when((n == m) & within(0.01), 4.0).otherwise(-10.0)
    alike = ratio(w["key"], t["key"])
    text = F.when(w["key"] == t["key"], 4.0).when(alike >= 0.8, 2.0 * alike).otherwise(-4.0)
    conflict = (w["family"] != "") & (family != "") & (w["family"] != family)
    return F.when(w["literal"] == "", 0.0).when(t["literal"] == "", -3.0).when(conflict, -14.0).when((n > 0) & (m > 0), sized).otherwise(text)


def length_score(written: Column, truth: Column) -> Column:
    """Bits of a written length: full within a millimetre, then down by two for each half per cent; -2 if the plan has none."""
    gap = F.abs(written - truth)
    return F.when(truth.isNull(), -2.0).when(gap <= 1, LENGTH_BITS).otherwise(F.greatest(F.lit(-8.0), LENGTH_BITS - (gap - 1) / F.greatest(F.lit(1.0), F.abs(truth) * 0.005) * 2.0))


def code_evidence(field: str, written: Column, truth: Column, channel: Column, orders: Column) -> Column:
    """Bits of a code in the second scorer; a sales order counts less the more orders it has."""
    w = F.lit(dict(CODE_WEIGHTS)[field])
    if field == "ov":
        w = w * F.greatest(F.lit(0.7), 1.0 - 0.1 * F.log2(F.greatest(orders, F.lit(1)).cast("double")))
    alike = ratio(written, truth)
    near = F.when(alike >= 0.9, F.greatest(F.lit(0.45), channel) * w).when(channel > 0, channel * w).otherwise(-0.55 * w)
    return F.when(F.coalesce(written, F.lit("")) == "", 0.0).when(F.coalesce(truth, F.lit("")) == "", -0.25 * w).when(written == truth, w).otherwise(near)


def geometry_evidence(w: Column, t: Column, written_material: Column, plan_material: Column, cut: Column, length: Column) -> Column:
    """Bits of one reading of profile, length and material together; cut: a length that the reading splits off, or null."""
    both = (written_material != "") & (plan_material != "")
    material = F.when(both, F.when(written_material == plan_material, MATERIAL_SAME).otherwise(MATERIAL_OTHER)).otherwise(0.0)
    return profile_score(w, t) + material - w["ocr_cost"] + F.when(cut.isNotNull(), length_score(cut.cast("double"), length) - SPLIT_COST).otherwise(0.0)


def dims_evidence(n_agree: Column, joint: Column, n_disagree: Column, total: Column) -> Column:
    """Bits of dimensions scored together: joint is the number of plan lines that agree in all that agree here."""
    share = F.greatest(joint / F.greatest(total, F.lit(1)), F.pow(F.lit(DIM_FLOOR), n_agree), F.lit(1e-9))
    agree = F.when(n_agree > 0, F.least(-F.log2(share), F.lit(DIM_CAP))).otherwise(0.0)
    return agree + F.when(n_disagree > 0, F.greatest(F.lit(DIM_DISAGREE_CAP), n_disagree * DIM_DISAGREE)).otherwise(0.0)

"""Dimensions by subsets, as-of joins at a day's edge, look-ups: against plain loops and hand-made rows."""

import math
import random
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tallyweave.operators import audit, balances, dims, linkage

TOLERANCES = {"a": 1.0, "b": 20.0, "c": 0.5}


def sides():
    rng = random.Random(3)
    value = lambda top, share: rng.randrange(top * 4) / 4 if rng.random() < share else None
    rows = [(i, value(6, 0.7), value(90, 0.7), value(3, 0.6)) for i in range(60)] + [(60, None, None, None), (61, 2.0, 40.0, 1.0), (62, 2.0, 40.0, 1.0)]
    lines = [(f"k{j:03}", value(6, 0.9), value(90, 0.8), value(3, 0.9)) for j in range(150)]
    return rows, lines + lines[:4]


def near(x, y, t):
    return x is not None and y is not None and abs(x - y) <= t


def test_candidates_by_the_dimensions_a_row_has(spark):
    rows, lines = sides()
    lines = [(f"{k}-{n}", *v) for n, (k, *v) in enumerate(lines)]
    left, right = spark.createDataFrame(rows, "i long, a double, b double, c double"), spark.createDataFrame(lines, "k string, a double, b double, c double")
    for cap in (500, 3):
        expected = set()
        for i, *v in rows:
            has = [n for n, x in enumerate(v) if x is not None]
            found = sorted(k for k, *w in lines if has and all(near(v[n], w[n], list(TOLERANCES.values())[n]) for n in has))
            expected |= {(i, k) for k in found[:cap]}
        assert set(map(tuple, dims.candidates(left, right, "i", "k", TOLERANCES, cap).collect())) == expected
    assert dims.candidates(left.limit(0), right, "i", "k", TOLERANCES).count() == dims.candidates(left, right.limit(0), "i", "k", TOLERANCES).count() == 0


def test_bits_of_pairs(spark):
    rows, lines = sides()
    lines = [(f"{k}-{n}", *v) for n, (k, *v) in enumerate(lines)]
    left, right = spark.createDataFrame(rows, "i long, a double, b double, c double"), spark.createDataFrame(lines, "k string, a double, b double, c double")
    pairs = left.select("i").where("i % 3 = 0 or i > 58").join(right.select("k").where("k < 'k04'"), F.lit(True))
    t = list(TOLERANCES.values())
    own, other = {i: v for i, *v in rows}, {k: v for k, *v in lines}
    got = dims.pair_bits(pairs, left, right, "i", "k", TOLERANCES).collect()
    assert len(got) == pairs.count() > 500
    for r in got:
        v, w = own[r["i"]], other[r["k"]]
        agree = [n for n in range(3) if near(v[n], w[n], t[n])]
        against = [n for n in range(3) if v[n] is not None and w[n] is not None and abs(v[n] - w[n]) - t[n] >= 3 * t[n]]
        joint = sum(all(near(v[n], x[n], t[n]) for n in agree) for x in other.values()) if agree else 0
        bits = min(12.0, -math.log2(max(joint / len(lines), 0.1 ** len(agree), 1e-9))) if agree else 0.0
        bits += max(-5.0, -2.5 * len(against)) if against else 0.0
        assert (r["agree"], r["disagree"], r["joint"]) == (len(agree), len(against), joint) and abs(r["bits"] - bits) < 1e-9, (v, w)


ZONE = ZoneInfo("Europe/Lisbon")


def test_one_edge_of_the_day_in_summer_and_winter(spark):
    """Loads within an hour of midnight in UTC and in Lisbon: each is before a day or from it on, never both, never neither."""
    rng = random.Random(1)
    days = [date(1998, 7, 15), date(1998, 1, 15), date(1998, 3, 29), date(1998, 10, 25), date(1998, 7, 16)]
    loads = [(f"s{i}{j}{k}", f"p{k}", datetime.combine(d, datetime.min.time()) + timedelta(minutes=m)) for i, d in enumerate(days) for j, m in enumerate((-90, -60, -30, -1, 0, 1, 30, 60, 360)) for k in range(2) if rng.random() < 0.9]
    asked = spark.createDataFrame([(d,) for d in (*days, days[0], date(1990, 1, 1), date(2005, 1, 1))], "day date")
    snapshots = spark.createDataFrame([(s, p, t) for s, p, t in loads], "snapshot_id string, dataset_id string, loaded_at timestamp")
    before = {(r["dataset_id"], r["day"]): r["snapshot_id"] for r in balances.asof_before(asked, snapshots).collect()}
    after = {}
    for r in sorted(balances.loads_from(asked, snapshots).collect(), key=lambda r: r["place"]):
        after.setdefault((r["dataset_id"], r["day"]), []).append(r["snapshot_id"])
    assert len(before) == 14
    for (p, d), found in before.items():
        cut = datetime.combine(d, datetime.min.time(), ZONE).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
        own = sorted((t, s) for s, q, t in loads if q == p)
        assert found == max(((t, s) for t, s in own if t < cut), default=(None, None))[1]
        assert after.get((p, d), []) == [s for t, s in own if t >= cut]
    assert before["p0", date(1998, 7, 15)] != before["p0", date(1998, 7, 16)]
    for df in (balances.asof_before(asked, snapshots), balances.loads_from(asked, snapshots), balances.nearest_load(asked, snapshots)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text
    assert balances.asof_before(asked, snapshots.limit(0)).count() == balances.loads_from(asked.limit(0), snapshots).count() == 0


def test_value_is_carried_over_stretches(spark):
    rows = [("a" if i % 3 else "b", i, f"v{i}" if i % 97 == 0 else None) for i in range(2000)]
    line = spark.createDataFrame(rows, "g string, at long, v string").repartition(7)
    last, expected = {}, {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        expected[i] = last[g]
    assert {r["at"]: r["v"] for r in balances.carried_asof(line, "g", ["at"], "v").collect()} == expected


LINES = "plan_key string, of_code string, ov string, perfil string, modelo string, qtd_restante double, falta_valida boolean"


def test_lookups(spark):
    plan = spark.createDataFrame([(f"k{i:02}", "OF1" if i < 3 else f"OF{i}", "OV7", "L60X60X5" if i % 2 else "HEA100", f"AT{i:02}", float(i) if i % 4 else 0.0, True) for i in range(60)], LINES)
    for blank in ("", "  ", None):
        assert audit.lookup(plan, blank).count() == 0
    found = audit.lookup(plan, "of1").collect()
    assert [r["plan_key"] for r in found] == ["k01", "k02"] and not found[0]["has_more"] and found[0]["mode"] == "of"
    assert {r["plan_key"] for r in audit.lookup(plan, "1", done=True).collect()} == {"k00", "k01", "k02"}
    page = audit.lookup(plan, "7", limit=10).collect()
    assert (len(page), page[0]["mode"], page[0]["has_more"]) == (1, "of", False)  # an order's number before a sales order's
    page = audit.lookup(plan, "OV7", offset=40, limit=10).collect()
    assert len(page) == 5 and not page[0]["has_more"] and audit.lookup(plan, "OV7", limit=10).first()["has_more"]
    assert audit.lookup(plan, "nothing").count() == 0
    assert [r["plan_key"] for r in audit.order_lines(plan, "1", "l").collect()] == ["k01"] and audit.order_lines(plan, "OF1").count() == 3 and audit.order_lines(plan, "OF1", " ").count() == 3


def test_a_value_on_more_lines_than_the_cap(spark):
    """Its row finds nothing under the cap and takes all its lines; a row with a rarer value does not."""
    plan = spark.createDataFrame([(f"k{i:03}", f"OF{300000 + i}", "OV0000009", "L60X60X5", "RARE" if i == 7 else "MANY") for i in range(501)], "plan_key string, of_code string, ov string, perfil string, modelo string")
    schema = "sheet_uid string, pos long, of_written string, ov_written string, perfil_written string, modelo_written string, perf_comp string, qtd_written string"
    rows = spark.createDataFrame([("many", 1, None, "0000009", None, None, None, "1"), ("rare", 1, None, "0000009", None, "RARE", None, "1"), ("none", 1, None, None, None, "?", None, "1")], schema)
    found = linkage.uncapped_candidates(linkage.carry_down(rows), plan).collect()
    assert len(found) == 501 and {r["sheet_uid"] for r in found} == {"many"}
    under = linkage.anchored_candidates(linkage.carry_down(rows), plan).collect()
    assert [(r["sheet_uid"], r["plan_key"]) for r in under] == [("rare", "k007")]

import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import linkage
from tallyloom.operators.agg import latest, leave_group_out, leave_one_out, most_frequent, pivot_facts, share, weighted_mean
from tallyloom.operators.asof import asof, band, nearest
from tallyloom.operators.ledger import exclude, leaves, subtotals
from tallyloom.operators.linkage import COLUMNS, link, link_loans
from tallyloom.operators.models import walk_forward
from tallyloom.operators.reported import known, quarters, versions
from tallyloom.operators.resample import bootstrap_difference, controls, nearest_profiles
from tallyloom.operators.subset import dropped
from tallyloom.operators.window import fifths, mean_rank, mid_percentile, spearman, t_stat, zscore
from tallyloom.session import DEALT, cut

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_pivot_counts_repeats_once_and_takes_peaks_and_lasts(spark):
    rows = [(1, "s", 5.0, 1), (1, "s", 5.0, 2), (1, "s", 7.0, 1), (1, "m", 0.1, 1), (1, "m", 0.3, 1), (1, "l", 1.0, 2), (1, "l", 2.0, 1), (1, "l", None, 9), (2, "s", None, 1)]
    got = {r.k: r for r in pivot_facts(spark.createDataFrame(rows, "k int, tag string, value double, at int"), ["k"], "tag", "value", ["s"], ["m"], ["l"], "at").collect()}
    assert (got[1].s, got[1].m, got[1].l) == (12.0, 0.3, 1.0) and got[2].s is None and got[2].l is None


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1), ("a", 3.0, 1.0, 2), ("a", None, 5.0, 3), ("b", None, 1.0, 1), ("b", None, 0.0, 2)], "g string, v double, w double, t int")
    got = {r.g: r for r in df.groupBy("g").agg(weighted_mean(F.col("v"), F.col("w")).alias("m"), share(F.col("w"), F.col("t") == 1).alias("s"), latest(F.col("v"), F.col("t")).alias("l")).collect()}
    assert (got["a"].m, got["a"].s, got["a"].l) == (pytest.approx(5 / 3), 0.25, 3.0) and got["b"].m is None and got["b"].l is None
    assert {(r.g, r.t) for r in most_frequent(df.unionByName(df.filter("t = 2")), ["g"], "t").collect()} == {("a", 2), ("b", 2)}
    others = {(r.g, r.t): r.o for r in leave_one_out(df, ["g"], "v", "o").collect()}
    assert others[("a", 1)] == 3.0 and others[("a", 3)] is None and others[("b", 1)] is None
    m = spark.createDataFrame([(1, "x", 1.0, 1.0), (1, "x", 0.8, 3.0), (1, "y", 0.5, 2.0), (2, "x", 0.9, 1.0)], "u int, mgr string, mark double, cost double")
    out = {(r.u, r.mgr, r.mark): r.p for r in leave_group_out(m, ["u"], "mgr", "mark", "cost", "p").collect()}
    assert out[(1, "x", 1.0)] == pytest.approx(0.5) and out[(1, "y", 0.5)] == pytest.approx(0.85) and out[(2, "x", 0.9)] is None


def brute_asof(left, right, back, tolerance, strict):
    out = {}
    for i, (k, t) in enumerate(left):
        ok = [(u, v) for q, u, v in right if q == k and k is not None and t is not None and (u < t if back else u > t) | (not strict and u == t)]
        if ok:
            best = (max if back else min)(ok, key=lambda p: (p[0], p[1]) if back else (p[0], -p[1]))
            out[i] = best[1] if tolerance is None or abs((best[0] - t).days) <= tolerance else None
        else:
            out[i] = None
    return out


@pytest.mark.parametrize("back,tolerance,strict", list(itertools.product([True, False], [None, 3], [True, False])))
def test_asof_same_as_brute_force(spark, back, tolerance, strict):
    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None]), D(rng.randrange(40)) if rng.random() > 0.1 else None) for _ in range(60)]
    right = [(rng.choice(["a", "b", "c"]), D(rng.randrange(40)), rng.randrange(99)) for _ in range(40)]
    l = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "i int, k string, t date")
    r = spark.createDataFrame(right, "k string, u date, v int")
    got = {x.i: x.v for x in asof(l, r, ["k"], "t", "u", ["v"], "backward" if back else "forward", tolerance, strict).collect()}
    assert got == brute_asof(left, right, back, tolerance, strict)


def test_band_and_nearest(spark):
    rng = random.Random(4)
    l = [("a", D(n)) for n in sorted(rng.sample(range(400), 40))]
    r = [("a", D(n), n) for n in sorted(rng.sample(range(400), 60))] + [("b", D(5), 5)]
    ls, rs = spark.createDataFrame(l, "k string, t date"), spark.createDataFrame(r, "k string, u date, v int")
    for low, high, target in [(-105, -75, -90), (75, 105, 75), (-3, 3, 0)]:
        got = {x.t: x.v for x in band(ls, rs, ["k"], "t", "u", low, high, ["v"], target).collect()}
        for k, t in l:
            ok = [((abs((u - t).days - target), (u - t).days), v) for q, u, v in r if q == k and low <= (u - t).days <= high]
            assert got[t] == (min(ok)[1] if ok else None)
    assert len(nearest(ls, rs, ["k"], "t", "u", 10, ["v"], shift=45).collect()) == len(l)


def test_ranks_and_percentiles(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (2, 3.0)], "g int, v double")
    got = sorted((r.g, r.v or -1, r.k, r.p) for r in df.select("g", "v", mean_rank("v", ["g"]).alias("k"), mid_percentile("v", ["g"]).alias("p")).collect())
    assert got == [(1, -1, None, None), (1, 5.0, 1.5, 0.25), (1, 5.0, 1.5, 0.25), (1, 7.0, 3.0, 1.0), (2, 3.0, 1.0, None)]
    z = [r.z for r in df.select(zscore("v", ["g"]).alias("z"), "g", "v").filter("g = 2").collect()]
    assert z == [None]


def test_spearman_fifths_and_t(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, 40).astype(float), rng.standard_normal(40)
    rows = [(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 1.0, float(i)) for i in range(8)] + [(3, float(i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r.g: r.ic for r in spearman(df, "x", "y", ["g"]).collect()}
    assert got[1] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank())) and got[2] is None and got[3] is None
    f = {r.g: r for r in fifths(df, "x", "y", ["g"]).collect()}
    order = sorted(zip(x, y))
    assert set(f) == {1} and f[1].spread == pytest.approx(np.mean([b for _, b in order[-8:]]) - np.mean([b for _, b in order[:8]]), abs=1e-6)
    assert df.groupBy("g").agg(t_stat(F.col("x")).alias("t")).filter("g = 2").first().t is None


def test_ledger_rules_see_live_rows_only(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, m int")
    live, ledger = exclude(df, ["k"], [("third", lambda d: d.filter("m = 0")), ("rest", lambda d: d.filter("k < 6"))], cut_every=1)
    assert {(r.k, r.reason) for r in ledger.collect()} == {(0, "third"), (3, "third"), (6, "third"), (1, "rest"), (2, "rest"), (4, "rest"), (5, "rest")}
    assert {r.k for r in live.collect()} == {7, 8}


def test_hierarchies(spark):
    rows = [(1, "A", 10.0), (1, "A | x", 4.0), (1, "A | y", 6.0), (1, "B", 5.0), (1, "B | z", 5.0), (2, "A", 10.0)]
    df = spark.createDataFrame(rows, "f int, t string, v double")
    assert [(r.f, r.t, r.n) for r in subtotals(df, ["f"], "t", ["v"]).collect()] == [(1, "A", 2)]
    assert {r.t for r in subtotals(df, ["f"], "t", ["v"], least=1).collect()} == {"A", "B"}
    sets = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x", "y"]), (1, "c", ["z"]), (1, "d", ["x", "y"]), (2, "a", ["x"])], "g int, n string, s array<string>")
    assert {(r.g, r.n) for r in leaves(sets, ["g"], "n", "s").collect()} == {(1, "b"), (1, "c"), (1, "d"), (2, "a")}


def brute_dropped(amounts, counts, fixed, total):
    n = len(amounts)
    if sum(amounts) <= 1.02 * total:
        return [False] * n
    for low, high in ((0.95, 1.03), (0.85, 1.05), (0.8, 1.15)):
        best = None
        for keep in itertools.product([False, True], repeat=n):
            if not any(keep) or any(f and not k for f, k in zip(fixed, keep)):
                continue
            s = sum(a for a, k in zip(amounts, keep) if k)
            if low * total <= s <= high * total:
                c = (abs(s - total), -sum(m for m, k in zip(counts, keep) if k))
                best = min(best or (c, keep), (c, keep), key=lambda p: p[0])
        if best:
            return best
    return [not f and a >= 0.5 * total for a, f in zip(amounts, fixed)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.integers(10, 120), st.integers(0, 3))
def test_subset_search_same_as_exhaustive(amounts, total, n_fixed):
    counts, fixed = [a % 5 + 1 for a in amounts], [i < n_fixed for i in range(len(amounts))]
    got, want = dropped(np.array(amounts, float), np.array(counts), np.array(fixed), float(total)), brute_dropped(amounts, counts, fixed, total)
    if isinstance(want, tuple):
        kept = [a for a, d in zip(amounts, got) if not d]
        rows = [c for c, d in zip(counts, got) if not d]
        assert (abs(sum(kept) - total), -sum(rows)) == want[0] and not any(g and f for g, f in zip(got, fixed))
    else:
        assert got.tolist() == want


def test_many_groups_are_folded():
    got = dropped(np.array([100.0] + [1.0] * 30 + [90.0]), np.ones(32), np.zeros(32), 130.0)
    assert got.tolist() == [False] * 31 + [True]


def row(period, ident, issuer, kind="loan", amount=100.0, **more):
    return {"lender": 1, "period": period} | dict.fromkeys(COLUMNS, "") | {"identifier": ident, "key": more.get("key", ident), "issuer": issuer, "kind": kind, "debt": more.get("debt", True), "maturity": more.get("maturity", ""), "amount": amount}


def test_every_stage_of_the_linkage_fires_and_order_does_not_matter():
    then = [row(1, "a", "A"), row(1, "b 1%", "B", key="b"), row(1, "c1", "C", maturity="2030"), row(1, "d1", "D"), row(1, "e1", "E", kind="loan"), row(1, "f1", "F", amount=100.0), row(1, "f2", "F", amount=500.0), row(1, "g1", "north harbor metals"), row(1, "h", "H")]
    now = [row(2, "a", "A"), row(2, "b 2%", "B", key="b"), row(2, "c2", "C", maturity="2030"), row(2, "d2", "D", maturity="x"), row(2, "e2", "E", kind="note"), row(2, "f3", "F", kind="k1", amount=480.0), row(2, "f4", "F", kind="k2", amount=90.0), row(2, "g2", "north harbour metals"), row(2, "i", "I")]
    later = [row(4, "h", "H"), row(4, "a", "A")]
    rows = then + now + later
    want = None
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        out, last, used = link(pd.DataFrame(rows), "1")
        got = {(r.period, r.identifier): (r.loan_id, r.match_method) for r in out.itertuples()}
        want = want or got
        assert got == want
    how = {k[1]: v[1] for k, v in got.items() if k[0] == 2}
    assert how == {"a": "exact", "b 2%": "key", "c2": "issuer_kind_maturity", "d2": "issuer_kind", "e2": "issuer_class", "f3": "issuer_amount", "f4": "issuer_amount", "g2": "fuzzy", "i": "new"}
    assert got[(2, "f3")][0] == got[(1, "f2")][0] and got[(4, "a")][0] == got[(1, "a")][0] and got[(4, "h")][1] == "new"
    assert len({v[0] for k, v in got.items() if k[0] == 2}) == 9


def test_all_periods_at_once_link_like_one_after_another(spark):
    rng = random.Random(6)
    names = ["north harbor metals", "north harbour metals", "quill works", "quil works", "vale", "orchard foods"]
    rows = [row(p, f"{n} {rng.choice(['a', 'b', 'c'])} {k}", n, kind=rng.choice(["loan", "note"]), amount=float(rng.randrange(50, 500)), maturity=rng.choice(["", "2030"])) | {"lender": lender}
            for lender in (1, 2, 3) for p in rng.sample(range(1, 12), 8) for k, n in enumerate(rng.sample(names, rng.randrange(1, 6)))]
    schema = "lender bigint, period int, identifier string, entity string, key string, issuer string, kind string, subtype string, maturity string, debt boolean, amount double"
    df = spark.createDataFrame([tuple(r[c] for c in ["lender", "period", *COLUMNS]) for r in rows], schema)
    got = {(r.lender, r.period, r.identifier): (r.loan_id, r.match_method) for r in link_loans(df.repartition(7)).collect()}
    want = {}
    for lender in (1, 2, 3):
        out, _, _ = link(pd.DataFrame([r for r in rows if r["lender"] == lender]), str(lender))
        want |= {(lender, r.period, r.identifier): (r.loan_id, r.match_method) for r in out.itertuples()}
    assert got == want and len({m for _, m in got.values()}) >= 5
    assert link_loans(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [4096, 4])
def test_linkage_in_stages_equals_row_by_row(spark, monkeypatch, pairs):
    """Many rows a key, equal, missing and negative amounts, null names and kinds; names met directly and by letter runs."""
    monkeypatch.setattr(linkage, "PAIRS", pairs)
    rng = random.Random(6)
    names = ["north harbor metals", "north harbour metals", "quill works", "quil works", "vale", "orchard foods", "orchard food", "works quill", "x y z holdings international", "x y zz holdings international", None, "acmeinternational", "acmeinternationals"]
    rows = []
    for lender in range(3):
        for p in rng.sample(range(1, 12), 6):
            for _ in range(rng.randrange(1, 40)):
                n = rng.choice(names)
                rows.append(dict(lender=lender, period=p, identifier=f"{n} {rng.choice('abc')}{rng.randrange(3)}", entity=rng.choice(["", "e"]), key=f"{n}{rng.randrange(2)}", issuer=n, kind=rng.choice(["loan", "note", None]), subtype="", maturity=rng.choice(["", "2030"]), debt=rng.random() < 0.7, amount=rng.choice([None, -5.0, float(rng.randrange(50, 90)), float(rng.randrange(50, 60))])))
    columns = ["lender", "period", *COLUMNS]
    schema = "lender bigint, period int, identifier string, entity string, key string, issuer string, kind string, subtype string, maturity string, debt boolean, amount double"
    plain = lambda r: tuple(str(getattr(r, c)).replace("nan", "None") for c in [*columns, "loan_id", "match_method"])
    got = sorted(map(plain, link_loans(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema).repartition(7)).collect()))
    want = []
    for lender in range(3):
        own = pd.DataFrame([r for r in rows if r["lender"] == lender]).astype({"amount": object})
        want += map(plain, link(own.where(own.notna(), None), str(lender))[0].itertuples())
    assert got == sorted(want) and len({r[-1] for r in got}) == 8


def test_quarters_out_of_sums_and_gaps(spark):
    day = lambda q: dt.date(2023, 3 * q, 31 if q in (1, 4) else 30)
    rows = [("a", day(q), q, "t", float(q * (q + 1) // 2)) for q in (1, 2, 3, 4)]  # sums since January
    rows += [("b", day(1), 1, "t", 5.0), ("b", day(3), 3, "t", 9.0), ("b", day(4), 4, "t", 20.0), ("b", day(4), 1, "t", 7.0)]  # no second quarter
    facts = spark.createDataFrame(rows, "e string, ddate date, qtrs int, tag string, value double")
    got = {(r.e, r.ddate): r.value for r in quarters(facts, "e").collect()}
    assert got == {("a", day(1)): 1.0, ("a", day(2)): 2.0, ("a", day(3)): 3.0, ("a", day(4)): 4.0, ("b", day(1)): 5.0, ("b", day(4)): 7.0}


def test_what_was_known_does_not_change_by_later_filings(spark):
    rng, day = random.Random(2), lambda n: dt.date(2023, 1, 1) + dt.timedelta(n)
    rows = [(e, day(90 * p), day(90 * p + rng.randrange(20, 400)), "t", float(rng.randrange(100))) for e in (1, 2) for p in range(8) for _ in range(rng.randrange(1, 4))]
    rows = list({r[:3]: r for r in rows}.values())
    facts = spark.createDataFrame(rows, "e int, p date, filed date, tag string, value double")
    asked = spark.createDataFrame([(e, day(n)) for e in (1, 2, None) for n in range(0, 1000, 37)], "e int, day date")

    def answers(f):
        told = versions(f, ["e", "p"], ["t"])
        return {(r.e, r.day): (r.p, r.filed, r.t) for r in known(asked, told, "e", "day", "p", ["t"]).collect()}

    got = answers(facts)
    for (e, when), r in got.items():
        seen = [(p, filed, v) for x, p, filed, _, v in rows if x == e and filed <= when]
        assert r == max(seen, default=(None, None, None))
    for cut_day in (day(300), day(500)):
        early = answers(facts.filter(F.col("filed") <= cut_day))
        assert all(early[k] == r for k, r in got.items() if k[1] <= cut_day)


def test_controls_by_the_ring(spark):
    pool = spark.createDataFrame([(q, 100 * q + i) for q in (1, 2) for i in range(60)], "q int, k int")
    events = spark.createDataFrame([(1, f"e{i}", 100 + i) for i in range(40)] + [(2, "f", 999)], "q int, event string, own int")
    near = spark.createDataFrame([(f"e{i}", 100 + (i + j) % 60) for i in range(40) for j in (1, 2)], "event string, k int")
    draw = lambda block: {(r.event, r.k) for r in controls(events, pool, ["q"], "event", "k", 5, seed=4, apart=near, most=2, own="own", block=block).collect()}
    got = draw(1000)
    assert got == draw(7)  # arcs don't matter
    by = {e: [k for x, k in got if x == e] for e in {e for e, _ in got}}
    assert len(by) == 41 and all(len(ks) == 5 for ks in by.values()) and all(k // 100 == (2 if e == "f" else 1) for e, k in got)
    assert not got & {(r.event, r.k) for r in near.collect()} and all((e, o) not in got for _, e, o in [tuple(r) for r in events.collect()])
    assert len({k for _, k in got}) > 40
    few = controls(events, pool.filter("k % 100 < 3"), ["q"], "event", "k", 5, seed=4)
    assert few.filter("event = 'f'").count() == 3


def test_walk_forward_uses_earlier_periods_only(spark):
    ics = spark.createDataFrame([("s", d, 0.1 * d if d < 9 else 99.0) for d in range(1, 10)], "signal string, date int, ic double")
    zs = spark.createDataFrame([("n", "s", d, 2.0) for d in range(1, 10)], "name string, signal string, date int, z double")
    assert {r.date for r in walk_forward(zs, ics, "date").collect()} == {5, 6, 7, 8, 9}


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.gauss(1.0 if t else 0.0, 1)) for c in range(60) for t in (True, False)]
    df = spark.createDataFrame(rows, "c int, t boolean, y double")
    a, b = bootstrap_difference(df, "c", "t", "y", 300, 1).first(), bootstrap_difference(df.repartition(5), "c", "t", "y", 300, 1).first()
    assert a.low < 1 < a.high and a.low < a.diff < a.high and (a.low, a.high) == pytest.approx((b.low, b.high))


def test_profiles_and_controls(spark):
    pool = spark.createDataFrame([(1, i, float(i), None if i % 4 == 0 else 1.0, i % 2) for i in range(12)], "q int, k int, a double, b double, s int")
    events = pool.filter("k = 5").withColumnRenamed("k", "e")
    near = nearest_profiles(events, pool, ["q"], "e", "k", ["a", "b"], 3, least=2, same="s").orderBy("rank").collect()
    assert [r.k for r in near] == [3, 7, 1] or [r.k for r in near][:2] == [3, 7]
    drawn = [sorted(r.k for r in controls(events, pool, ["q"], "e", "k", 4, seed=s).collect()) for s in (1, 1, 2)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 4


def test_a_rule_runs_once_for_what_it_takes_and_what_it_leaves(spark):
    ran = spark.sparkContext.accumulator(0)

    def each(frames):
        for f in frames:
            ran.add(len(f))
            yield f[f["k"] % 2 == 0]

    live, ledger = exclude(spark.range(10).withColumnRenamed("id", "k"), ["k"], [("even", lambda d: d.mapInPandas(each, "k bigint"))])
    assert live.count() == 5 and ledger.count() == 5 and ran.value == 10


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_of_a_lender_stay_where_they_are(spark):
    from tallyloom.operators.linkage import _counted
    from tallyloom.session import cut

    rows = spark.createDataFrame([(i % 3, i % 2, i % 2, i, f"k{i % 4}", None) for i in range(40)], "lender int, period int, _side int, _n int, key string, _to int")
    group = ["lender", "period"]
    rows = cut(rows.repartition("lender").select("*", F.count("*").over(Window.partitionBy(*group)).alias("all")), dealt=True)
    assert exchanges(_counted(_counted(rows, group, ["key"]).drop("_c0", "_m0", "_c1", "_m1"), group, ["_n"])) == 0
    before = spark.conf.get("spark.sql.adaptive.enabled")
    joined = cut(rows.join(rows.groupBy(*group).agg(F.max("_n").alias("most")), group), dealt=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before and joined.count() == 40
    assert exchanges(joined.groupBy(*group, "_n").count()) == 0


def test_holdings_are_dealt_to_lenders_once(spark):
    from tallyloom.plans.binding import computed_holdings
    from tallyloom.plans.signals import loan_quarters

    lq = loan_quarters(computed_holdings(spark, "/root/testdata/sf0.001", dealt=True))
    assert exchanges(lq.groupBy("lender", "period").agg(F.sum("mark_chg1"))) == 1


def test_a_scorecard_deals_lines_to_lenders(spark):
    from tallyloom.plans.models import lender_scorecard

    plan = lender_scorecard(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan


def test_loan_features_and_lender_quarters_compute_holdings_once(spark, tmp_path):
    from tallyloom.plans import models, signals
    from tallyloom.plans.binding import holdings

    sf = "/root/testdata/sf0.001"
    book = signals.lender_quarters(signals.loan_quarters(holdings(spark, sf, dealt=True)))
    for df in (models.loan_features(spark, sf), book):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_extendedprice") and plan.count("Relation") == 2  # lineitem and part


def test_spearman_deals_rows_to_their_groups_once(spark):
    from tallyloom.operators.window import spearman

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None)], "g string, x double, y double")
    assert spearman(df, "x", "y", ["g"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_nearest_profiles_go_by_own_kind_first_and_take_rows_without_a_kind_last(spark):
    pool = [(1, i, float(i), 2.0, "x" if i < 4 else "y") for i in range(40)] + [(1, 90, 0.0, 2.0, None), (1, 91, float("nan"), 2.0, "x"), (1, 92, None, 2.0, "x"), (2, 93, 0.0, 2.0, "x")]
    pool = spark.createDataFrame(pool, "q int, k int, a double, b double, s string")
    events = pool.filter("k IN (0, 20)").withColumnRenamed("k", "e")
    near = nearest_profiles(events, pool, ["q"], "e", "k", ["a", "b"], 42, least=2, same="s").orderBy("e", "rank")
    got = {e: [r.k for r in near.collect() if r.e == e] for e in (0, 20)}
    # NaN is farthest, a null feature leaves one, which is too few
    assert got[0] == [1, 2, 3, 91, *range(4, 40), 90]
    assert got[20][:4] == [19, 21, 18, 22] and got[20][35:] == [3, 2, 1, 0, 91, 90]
    few = nearest_profiles(events, pool, ["q"], "e", "k", ["a", "b"], 5, least=2, same="s")
    assert [r.k for r in few.filter("e = 20").orderBy("rank").collect()] == [19, 21, 18, 22, 17] and [r.k for r in few.filter("e = 0").orderBy("rank").collect()] == [1, 2, 3, 91, 4]


def test_borrower_profiles_compute_holdings_once(spark):
    from tallyloom.plans import peers

    plan = peers._features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Relation" not in plan


def test_names_that_meet_again_are_compared_once(monkeypatch):
    asked = []
    ratio = linkage.token_set_ratio
    monkeypatch.setattr(linkage, "token_set_ratio", lambda a, b: asked.append((a, b)) or ratio(a, b))
    row = {c: "" for c in COLUMNS} | {"kind": "loan", "debt": True}
    book = lambda lender: pd.DataFrame([row | {"lender": lender, "period": p, "identifier": n, "key": n, "issuer": n, "debt": p, "amount": 1.0} for p, n in ((1, "northern lumber zq"), (2, "northern lumbers zq"))])
    linked = [link(book(n), str(n))[0] for n in range(5)]
    assert all(list(f["match_method"]) == ["new", "fuzzy"] for f in linked) and len(asked) == 1


def test_fundamentals_take_the_facts_once_and_nav_known_no_flows(spark):
    from tallyloom.plans import fundamentals

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan(fundamentals.fundamentals(spark, "/root/testdata/sf0.001"))
    known_plan = plan(fundamentals.nav_known(spark, "/root/testdata/sf0.001"))
    assert "NetInvestmentIncome" not in known_plan and "StockholdersEquity" in known_plan


def test_rules_read_dealt_rows_where_they_lie(spark):
    df = spark.range(1000).selectExpr("id % 50 AS g", "id AS k", "id % 7 AS m")
    df = cut(df.repartition("g").sortWithinPartitions("g", "k"), dealt=True)
    rules = [("third", lambda d: d.filter("m = 0")), ("rest", lambda d: d.filter("k < 60")), ("twice", lambda d: d.join(d.groupBy("g").agg(F.min("k").alias("k")), ["g", "k"]))]
    plain, dealt = exclude(df, ["g", "k"], rules), exclude(df, ["g", "k"], rules, dealt=True)
    for a, b in zip(plain, dealt):
        assert sorted(a.collect()) == sorted(b.collect()) and b.count() > 50
    for key, value in DEALT.items():
        spark.conf.set(key, value)
    try:
        assert "Exchange hashpartitioning" not in dealt[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in DEALT:
            spark.conf.unset(key)


def test_heading_subtotals_go_by_filings_where_lines_lie(spark):
    from tallyloom.plans import cleaning

    for key, value in DEALT.items():
        spark.conf.set(key, value)
    try:
        book = cleaning._book(spark, "/root/testdata/sf0.001", dealt=True)
        live = book.join(subtotals(book, ["filing"], "text", ["amount"], least=1), ["filing", "text"], "left_anti")
        plan = live.groupBy("filing").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in DEALT:
            spark.conf.unset(key)
    assert "REPARTITION_BY_COL" in plan and "Exchange hashpartitioning" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(filing" in x and "REPARTITION_BY_COL" not in x]

"""Operators against plain versions on random rows, and what their plans and tasks look like with hot keys and dense events."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import keys, quantiles
from pitpanel.operators import actions, outcomes, panel, performance, pit
from pitpanel.sources import readers

D0 = datetime.date(2015, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=int(n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def frames(spark):
    rng = np.random.default_rng(4)
    key = lambda n: np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c", "e"], n))
    left = pd.DataFrame({"k": key(900), "t": rng.integers(0, 1500, 900)}).drop_duplicates()
    right = pd.DataFrame({"k": key(250), "u": rng.integers(0, 1500, 250)}).drop_duplicates()
    right["v"] = np.arange(len(right)) * 1.5
    return left, right, rows(spark, left, "k string, t date"), rows(spark, right, "k string, u date, v double")


def rows(spark, frame, schema):
    dates = {c.split()[0] for c in schema.split(", ") if c.endswith(" date")}
    kinds = [day if c in dates else str if frame[c].dtype == object else float for c in frame.columns]
    return spark.createDataFrame([tuple(f(x) for f, x in zip(kinds, r, strict=True)) for r in frame.itertuples(index=False)], schema)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("within", [None, 20])
def test_asof_equals_pandas(frames, forward, exact, within):
    left, right, l, r = frames  # noqa: E741
    want = pd.merge_asof(
        left.sort_values("t"), right.sort_values("u").rename(columns={"u": "t"}).assign(u=lambda x: x["t"]), on="t", by="k",
        direction="forward" if forward else "backward", allow_exact_matches=exact, tolerance=within,
    )
    want = sorted(((k, day(t), None if pd.isna(v) else v) for k, t, v in zip(want["k"], want["t"], want["v"], strict=True)), key=str)
    for blocks in (7, 92, None):
        out = pit.asof_join(l, r, "k", "t", "u", forward=forward, exact=exact, within=within, block_days=blocks)
        assert sorted((tuple(x) for x in out.select("k", "t", "v").collect()), key=str) == want


def test_asof_takes_timestamps_numbers_and_nulls(spark):
    at = lambda *x: spark.createDataFrame(list(x), "k string, t string").withColumn("t", F.to_timestamp("t"))
    left, right = at(("a", "2020-01-01 10:00:00"), ("a", None), ("a", "2021-06-01 00:00:00"), (None, "2021-06-01 00:00:00")), at(("a", "2020-01-01 09:59:59"), ("a", None))
    got = pit.asof_join(left, right.withColumnRenamed("t", "u"), "k", "t", "u", within=1).select("k", "u").collect()
    assert sorted(str(r["u"]) for r in got) == ["2020-01-01 09:59:59", "None", "None", "None"]
    numbers = spark.createDataFrame([("a", 5), ("a", 900)], "k string, t int")
    got = pit.asof_join(numbers, numbers.filter("t = 5").toDF("k", "u"), "k", "t", "u", forward=True).orderBy("t").collect()
    assert [r["u"] for r in got] == [5, None]
    with pytest.raises(ValueError):
        pit.asof_join(left, numbers.toDF("k", "u"), "k", "t", "u")


def test_asof_parts_a_hot_key(spark):
    """A key with half of the rows is sorted in many tasks."""
    n = 40_000
    left = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.date_add(F.lit(D0), (F.col("id") % 3000).cast("int")).alias("t"))
    right = left.filter("day(t) = 1").distinct().withColumnRenamed("t", "u")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda days: pit.asof_join(left, right, "k", "t", "u", block_days=days).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("u").alias("u")).agg(F.max("n"), F.max("u")).first()[0]
        assert most(None) >= n / 2 and most(92) < n / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_result_lag_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    periods = {(int(i), int(t)) for i, t in zip(rng.integers(0, 4, 60), rng.integers(0, 1200, 60), strict=True)}
    said = [(int(i), int(t)) for i, t in zip(rng.integers(0, 4, 90), rng.integers(0, 1300, 90), strict=True)]
    p = spark.createDataFrame([(i, day(t)) for i, t in periods], "id int, period_end date")
    a = spark.createDataFrame([(i, day(t)) for i, t in said] + [(1, None)], "id int, date date")
    out = pit.result_lag(p.union(p), a)
    want = []
    for i, t in periods:
        first = min((u for j, u in said if j == i and t < u <= t + 100), default=None)
        want.append((i, day(t), day(t + 45 if first is None else first), first is not None, 45 if first is None else first - t))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Join" not in plan(out)  # nothing multiplies rows


def test_membership_runs_are_the_dense_panel(spark):
    rng = np.random.default_rng(1)
    calendar = spark.createDataFrame([(day(t),) for t in range(0, 300, 2)], "date date")
    held = [(s, day(t), None if rng.random() < 0.1 else float(rng.integers(0, 10))) for s in "abcd" for t in sorted(rng.choice(300, 40, replace=False))]
    m = spark.createDataFrame([*held, ("none", day(1), None), ("off", day(3), 9.0)], "symbol string, date date, mcap double")
    for limit in (0, 3, 10):
        dense = panel.ffill(panel.densify(m, calendar), ["mcap"], limit).select("symbol", "date", F.coalesce(F.col("mcap") > 4, F.lit(False)).alias("member"))
        got = pit.membership_panel(m, calendar, 4, limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense.collect()))
        runs = pit.membership_runs(m, calendar, 4, limit)
        bars = calendar.crossJoin(m.select("symbol").distinct()).withColumn("eligible", F.lit(True))
        by_runs = panel.gate_membership(bars, runs).select("symbol", "date", "eligible")
        assert sorted(map(tuple, by_runs.collect())) == sorted(map(tuple, panel.gate_membership(bars, dense).select("symbol", "date", "eligible").collect()))
        assert runs.count() == len({(r["symbol"], r["from_date"]) for r in runs.collect()}) <= dense.filter("member").count()
    assert pit.membership_panel(m, calendar.limit(0), 4).count() == 0 == pit.membership_panel(m.limit(0), calendar, 4).count()


def test_membership_shuffles_rows_not_the_grid(spark):
    calendar = spark.range(3000).select(F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    m = spark.range(400).select((F.col("id") % 200).alias("symbol"), F.date_add(F.lit(D0), (F.col("id") * 7 % 3000).cast("int")).alias("date"), F.lit(9.0).alias("mcap"))
    out = pit.membership_panel(m, calendar, 4)
    text = plan(out)
    assert 0 < text.index("explode(days") < text.index("hashpartitioning(symbol")  # top down: all shuffles lie under the grid
    assert out.count() == 200 * 3000


def test_confirmed_steps_are_the_nearest(spark):
    rng = np.random.default_rng(6)
    canon = np.array(actions.CANONICAL)
    gaps = [(s, int(t), float(rng.choice(canon) * rng.choice([1, 1.02, 0.97]))) for s in "ab" for t in rng.integers(0, 3000, 60)]
    steps = sorted({(s, int(t), float(rng.choice([*canon[:5], 0.5]))) for s in "ab" for t in rng.integers(0, 3000, 40)})
    c = spark.createDataFrame([(s, day(t), r) for s, t, r in gaps], "symbol string, date date, ratio double")
    st = spark.createDataFrame([(s, day(t), x) for s, t, x in steps], "symbol string, date date, step double")
    snapped = c.select("symbol", F.col("date").alias("ex_date"), actions.snap_ratio(F.col("ratio"), 0.08).alias("ratio")).collect()
    want = {}
    for s, ex, ratio in snapped:
        near = [(abs((day(t) - ex).days), day(t)) for u, t, x in steps if u == s and abs((day(t) - ex).days) <= 380 and abs(x / ratio - 1) <= 0.08]
        if near:
            want[s, ex] = min(want.get((s, ex), (9999, None)), min(near))
    got = {(r["symbol"], r["ex_date"]): r["step_date"] for r in actions.confirm_actions(c, st).collect()}
    assert got == {k: v[1] for k, v in want.items()} and len(got) > 20


def plain_matches(p, t, days, tolerance):
    pairs = sorted({(abs(a - b), s, a, b) for s, a, x in p for u, b, y in t if s == u and abs(a - b) <= days and abs(x / y - 1) <= tolerance})
    used, n = set(), 0
    for _, s, a, b in pairs:
        if ("p", s, a) not in used and ("t", s, b) not in used:
            used |= {("p", s, a), ("t", s, b)}
            n += 1
    return n


def test_sweeps_match_as_the_greedy_rule(spark):
    rng = np.random.default_rng(12)
    frame = lambda x: spark.createDataFrame([(s, day(t), r) for s, t, r in x], "symbol string, date date, ratio double")
    for span, n in ((12, 20), (40, 60), (60, 40)):
        make = lambda: [(str(rng.choice(["a", "b"])), int(t), float(rng.choice([2.0, 2.1, 3.0]))) for t in rng.integers(0, span, n)]  # noqa: E731, B023
        p, t = make(), make()
        out = actions.match_events(frame(p), frame(t)).first()
        assert (out["tp"], out["fp"], out["fn"]) == ((tp := plain_matches(p, t, 3, 0.1)), n - tp, n - tp)


def test_sweep_of_a_dense_symbol(spark):
    """100,000 predictions and as many truths, one a day, of one symbol: one run without a break."""
    n = 100_000
    at = lambda off: spark.range(n).select(F.lit("s").alias("symbol"), F.date_add(F.lit("1800-01-01").cast("date"), (F.col("id") + off).cast("int")).alias("date"), F.lit(2.0).alias("ratio"))
    out = actions.match_events(at(0), at(2)).first()
    assert (out["tp"], out["fp"], out["fn"]) == (n - 2, 2, 2)


def test_upsert_moves_only_what_the_increment_touches(spark):
    rng = np.random.default_rng(2)
    base = [(f"s{i}", day(t), float(i + t)) for i in range(60) for t in range(50)] + [(None, day(1), 1.0), ("s1", None, 2.0)]
    inc = [(f"s{rng.integers(0, 70)}", day(rng.integers(40, 60)), float(k), k) for k in range(150)] + [(None, day(1), 7.0, 1), ("s1", None, 8.0, 1), (None, day(1), 6.0, 0)]
    b = spark.createDataFrame(base, "symbol string, date date, close double")
    i = spark.createDataFrame(inc, "symbol string, date date, close double, at long")
    out = readers.upsert(b.withColumn("at", F.lit(None).cast("long")), i, ["symbol", "date"], "at")
    want = {r[:2]: r[2] for r in base} | {r[:2]: r[2] for r in sorted(inc, key=lambda r: r[3])}
    assert sorted(((r["symbol"], r["date"], r["close"]) for r in out.collect()), key=str) == sorted(((*k, v) for k, v in want.items()), key=str)
    touched, rest = keys.split_by_keys(b, ["symbol", "date"], i)
    shared = {r[:2] for r in base} & {r[:2] for r in inc}
    assert touched.count() <= len(shared) + 3 and touched.count() + rest.count() == len(base)
    assert not {tuple(r) for r in rest.select("symbol", "date").collect()} & shared
    assert "hashpartitioning(symbol" not in plan(rest)  # what isn't touched passes through
    crowded, _ = keys.split_by_keys(b, ["symbol", "date"], i, bits=64)  # a full bitmap loses nothing
    assert shared <= {tuple(r) for r in crowded.select("symbol", "date").collect()}
    assert readers.upsert(b, b.limit(0), ["symbol", "date"]).count() == len(base) == readers.upsert(b.limit(0), b, ["symbol", "date"]).count()


def test_variants_share_a_ranking(spark):
    rng = np.random.default_rng(3)
    rows = [(day(t), f"s{i}", f"sec{i % 4}", bool(rng.random() < 0.9), None if rng.random() < 0.1 else float(rng.integers(0, 9))) for t in range(12) for i in range(30)]
    p = spark.createDataFrame(rows, "date date, symbol string, sector string, eligible boolean, score double")
    made = lambda ns, caps: spark.createDataFrame([(f"n={n},cap={c}", n, c) for n in ns for c in caps], "variant string, n int, sector_cap int")
    for ascending in (False, True):
        grid = made((1, 3, 8), (1, 2, 50))
        want = set()
        for n, c in [(n, c) for n in (1, 3, 8) for c in (1, 2, 50)]:
            for d in {r[0] for r in rows}:
                own, taken = sorted(((r[4], r[1], r[2]) for r in rows if r[0] == d and r[3] and r[4] is not None), reverse=not ascending), []
                for v, s, sec in own:  # the greedy rule
                    if len(taken) < n and sum(x[1] == sec for x in taken) < c:
                        taken.append((s, sec))
                want |= {(f"n={n},cap={c}", d, s, k + 1) for k, (s, _) in enumerate(taken)}
        got = outcomes.top_n_variants(p, grid, "score", ascending)
        assert {(r["variant"], r["date"], r["symbol"], r["position"]) for r in got.collect()} == want
    shuffles = [plan(outcomes.top_n_variants(p, made(ns, (2,)), "score")).count("hashpartitioning(date") for ns in ((1,), tuple(range(1, 40)))]
    assert shuffles[0] == shuffles[1]


def test_merged_blocks_are_the_whole_curve(spark):
    rng = np.random.default_rng(5)
    rows = [(v, day(t), float(100 * np.exp(x))) for v in "abc" for t, x in zip(sorted(rng.choice(900, 300, replace=False)), np.cumsum(rng.normal(0, 0.02, 300)), strict=True)]
    rows += [("one", day(40), 5.0), ("flat", day(10), 3.0), ("flat", day(500), 3.0)]
    nav = spark.createDataFrame(rows, "variant string, date date, nav double")
    spans = [(k, day(a), day(a + n)) for k, (a, n) in enumerate([(0, 900), (0, 300), (100, 50), (300, 601), (39, 2), (400, 0), (2000, 10), (0, 300)])]
    windows = spark.createDataFrame(spans, "window int, start date, end date")
    got = {(r["window"], r["variant"]): r for r in performance.window_summaries(nav, windows, ["window"]).collect()}
    want = {}
    for k, a, b in spans:
        part = nav.filter(F.col("date").between(F.lit(a), F.lit(b)))
        want |= {(k, r["variant"]): r for r in performance.returns_summary(part).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        for c in ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown"):
            assert got[key][c] == pytest.approx(r[c], rel=1e-8, abs=1e-12), (key, c)
    # every day is summarised once, however many windows hold it
    once = [plan(performance.window_summaries(nav, windows.filter(f"window < {k}"), ["window"])) for k in (1, 8)]
    assert once[0].count("Window") == once[1].count("Window") and once[1].count("Scan ExistingRDD[variant") == 1


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(7)
    groups = {"ties": rng.integers(0, 4, 5000).astype(float), "heavy": np.exp(rng.normal(0, 30, 5000)), "one": np.array([3.0]), "two": np.array([1.0, 4.0]), "same": np.full(900, 2.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("two", None), (None, 5.0)], "g string, v double")
    probs = (0.0, 0.1, 0.5, 0.9, 0.99995, 1.0)
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got == {(g, p): pytest.approx(float(np.quantile(vs, p)), rel=1e-9) for g, vs in {**groups, None: np.array([5.0])}.items() for p in probs}
    every = df.filter("v is not null").toPandas()["v"]
    whole = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, [], "v", (0.25, 0.5)).collect()}
    assert whole == {p: pytest.approx(float(np.quantile(every, p)), rel=1e-9) for p in (0.25, 0.5)}
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_a_bracket_holds_few_rows(spark):
    """Of 200,000 different values a few hundred are looked at one by one."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    out = quantiles.exact_quantiles(df, [], "v", [0.5])
    assert out.first()["quantile"] == pytest.approx(float(np.quantile(df.toPandas()["v"], 0.5)))
    sketch = df.agg(F.percentile_approx("v", 0.5 - 3 / quantiles.ACCURACY, quantiles.ACCURACY).alias("a"), F.percentile_approx("v", 0.5 + 3 / quantiles.ACCURACY, quantiles.ACCURACY).alias("b"))
    a, b = sketch.first()
    assert df.filter(F.col("v").between(a, b)).count() < 400


@pytest.mark.parametrize("entry_day, max_hold, delisted", [(True, None, False), (False, 40, False), (True, 25, True), (False, None, True)])
def test_zones_find_what_all_days_find(spark, entry_day, max_hold, delisted):
    rng = np.random.default_rng(13)
    bars = []
    for s in "abc":
        price = 100.0
        for t in sorted(rng.choice(420 if s != "c" else 200, 150, replace=False)):
            price *= float(np.exp(rng.normal(0, 0.03)))
            low, high = price * (1 - rng.random() * 0.03), price * (1 + rng.random() * 0.03)
            cells = [price * (1 + rng.normal(0, 0.02)), high, low, price]
            bars.append((s, day(t), *[None if rng.random() < 0.03 else float(x) for x in cells]))
    spans = []
    for k in range(80):
        s, a = str(rng.choice(["a", "b", "c", "d"])), int(rng.integers(0, 380))
        near = [r for r in bars if r[0] == s and r[1] >= day(a) and r[5]]
        level = near[0][5] if near else 100.0
        spans.append((k, s, near[0][1] if near and rng.random() < 0.8 else day(a), day(a + int(rng.integers(0, 200))), str(rng.choice(["rebalance", "end"])),
                      None if rng.random() < 0.1 else level * 0.9, None if rng.random() < 0.1 else level * 1.15))
    sp = spark.createDataFrame(spans, "id int, symbol string, entry_date date, exit_date date, exit_reason string, stop double, target double")
    b = spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double")
    got = {r["id"]: (r["exit_date"], r["exit"], r["exit_reason"], r["entry"]) for r in outcomes.first_touch(sp, b, entry_day, max_hold, delisted=delisted, keys=["id"]).collect()}
    ends = {s: max(r[1] for r in bars if r[0] == s and r[5] is not None) for s in "abc"}
    want = {}
    for k, s, a, z, why, stop, target in spans:
        own, events = sorted(r for r in bars if r[0] == s and a <= r[1] <= z), []
        for n, (_, d, o, h, lo, c) in enumerate(own):
            live = None not in (h, lo, c) and (entry_day or d > a)
            planned = d == z
            if planned and why == "rebalance":
                events.append((d, 0, c if o is None else o, why))
            if live and stop is not None and lo <= stop:
                events.append((d, 1, stop if o is None or o >= stop else o, "stop"))
            if live and target is not None and h >= target:
                events.append((d, 2, target if o is None or o <= target else o, "target"))
            if live and max_hold and (d - a).days >= max_hold:
                events.append((d, 3, c, "time"))
            if delisted and d == ends[s] and d < max(ends.values()):
                events.append((d, 4, c, "delisted"))
            if planned and why != "rebalance":
                events.append((d, 5, c, why))
            if n == len(own) - 1:
                events.append((d, 6, c, why))
        if events:
            d, _, price, reason = min(events, key=lambda e: e[:2])
            want[k] = (d, price, reason, next((r[2] for r in own if r[1] == a), None))
    assert got == want and len({v[2] for v in got.values()}) >= 4


def test_zones_prune_days(spark):
    """Of ten years of days a span meets the months around its one touch."""
    days = spark.range(3650).select(F.lit("a").alias("symbol"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"), (100 + F.col("id") * 0.01).alias("close"))
    bars = days.select("symbol", "date", F.col("close").alias("open"), (F.col("close") + 0.1).alias("high"), (F.col("close") - 0.1).alias("low"), "close")
    spans = spark.range(200).select(F.col("id"), F.lit("a").alias("symbol"), F.lit(D0).alias("entry_date"), F.lit(day(3640)).alias("exit_date"), F.lit("end").alias("exit_reason"), F.lit(1.0).alias("stop"), (110 + F.col("id") * 0.1).alias("target"))
    met = outcomes.touchable_days(spans, bars, ["id", "symbol", "entry_date"]).count()
    assert 200 * 20 < met < 200 * 40 and 200 * 3640 > 90 * met
    out = outcomes.first_touch(spans, bars, keys=["id"])
    assert out.filter("exit_reason = 'target'").count() == 200


def test_first_touch_moves_bars_once(spark, sf):
    """One shuffle of the lines that bars come from, one of the months of spans, one of what they find, and the positions it is put beside."""
    from pitpanel.plans import catalog_more

    plan = catalog_more.i2_i4_first_touch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("lineitem.parquet") <= 3


def test_share_proxies_pivot_once(spark):
    """The proxies of one table come from one pivot of it; a task of three pivots side by side held three tables of groups."""
    eav = spark.createDataFrame([(1, D0, m, v) for m, v in (("NP", 6.0), ("EPS", 2.0), ("EQUITY", 8.0), ("BVPS", 4.0))] + [(2, D0, "NP", 5.0), (2, D0, "EPS", -1.0)], "id int, date date, metric string, value double")
    hist = spark.createDataFrame([(1, D0, 10.0, 2.0)], "id int, period_end date, net_profit_owner double, eps double")
    out = actions.share_proxies(eav, hist)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert sorted((r["symbol"], r["shares"], r["source"]) for r in out.collect()) == [(1, 2.0, "equity_bvps"), (1, 3.0, "np_eps"), (1, 5.0, "owner_eps")]


def test_bar_files_derive_bars_once(spark, sf, monkeypatch):
    from pitpanel.plans import catalog_sources
    from pitpanel.plans import fixtures as fx

    calls, bars = [], fx.bars
    monkeypatch.setattr(fx, "bars", lambda s, d: calls.append(d) or bars(s, d))
    path = catalog_sources._bar_files(spark, sf)
    b = bars(spark, sf)
    assert calls == [sf] and spark.read.parquet(path).count() == b.count() + b.filter("volume > 40").count()


def test_delistings_ask_for_dead_symbols_only(spark, sf):
    from pitpanel.plans import catalog_more

    plan = catalog_more.f7_delistings(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 5) = 0)") >= 5

"""Operators on small planted files and frames: formats, edge cases, no look-ahead, streams."""

import datetime as dt
import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions import columns, indicators
from pitpanel.operators import actions, fundamentals, outcomes, panel, performance, pit, selection
from pitpanel.plans import fixtures as fx
from pitpanel.plans.strategy import StrategySpec, evaluate, selections
from pitpanel.sources import readers
from pitpanel.streaming import jobs

D = dt.date


def days(n, start="2020-01-01"):
    return [x.date() for x in pd.bdate_range(start, periods=n)]


def bars(spark, closes, symbol="A", start="2020-01-01", spread=0.0):
    rows = [(symbol, d, c, c + spread, c - spread, c, c, 100.0) for d, c in zip(days(len(closes), start), map(float, closes), strict=True)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double")


def test_both_bar_formats(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "new").mkdir()
    (tmp_path / "old/a.csv").write_text(
        " SYMBOL, SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP\nAAA,EQ,1,2,0.5,1.5,1.5,1,100,150,02-JAN-2024\nBBB,GB,1,2,0.5,1.5,1.5,1,100,150,02-JAN-2024\nCCC,BE,x,2,0.5,,1.5,1,100,150,02-JAN-2024\n"
    )
    (tmp_path / "new/b.csv").write_text(
        "TradDt,TckrSymb,SctySrs,ISIN,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\n2024-07-09,AAA.NS,EQ,I1,-,2,0.5,1.75,1.5,1,100,150,7\n2024-01-03,AAA,EQ,I1,1,2,0.5,9,1.5,1,100,150,7\n"
    )
    out = {r["date"]: r for r in readers.read_bars(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()}
    assert sorted(out) == [D(2024, 1, 2), D(2024, 7, 9)]
    assert out[D(2024, 7, 9)]["open"] is None and out[D(2024, 7, 9)]["symbol"] == "AAA" and out[D(2024, 1, 2)]["n_trades"] is None


def test_csv_table_fails_on_malformed_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,z\n')
    assert readers.read_csv_table(spark, str(tmp_path)).collect() == [(1, "x, y"), (2, "z")]
    (tmp_path / "u.csv").write_text("a,b\nno,z\n")
    with pytest.raises(Exception):
        readers.read_csv_table(spark, str(tmp_path), "a int, b string").collect()


def test_cleaning(spark):
    df = spark.createDataFrame([("1,234.5", "Mar 2024", "01-Feb-2024"), ("12 %", "Dec-2023", "2024-02-30"), ("-", "TTM", "NA"), ("₹ 7", None, None)], "n string, p string, d string")
    out = df.select(columns.clean_number(F.col("n")), columns.period_end(F.col("p")), columns.clean_date(F.col("d"))).collect()
    assert [tuple(r) for r in out] == [(1234.5, D(2024, 3, 31), D(2024, 2, 1)), (12.0, D(2023, 12, 31), None), (None, None, None), (7.0, None, None)]


def test_replace_partition_and_export(spark, tmp_path):
    path = str(tmp_path / "snap")
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, snapshot_date date, x int")
    readers.replace_partition(frame([("A", D(2020, 1, 1), 1), ("A", D(2020, 2, 1), 2)]), path)
    readers.replace_partition(frame([("B", D(2020, 2, 1), 3)]), path)
    assert sorted((r["symbol"], r["x"]) for r in spark.read.parquet(path).collect()) == [("A", 1), ("B", 3)]
    orders = spark.createDataFrame([("A", "buy", float("nan"), 1.0)], "symbol string, action string, price double, stop double")
    readers.write_orders(orders, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(readers.ORDER_COLUMNS)
    readers.write_orders(orders, str(tmp_path / "json"), "json")
    assert spark.read.text(str(tmp_path / "json")).first()[0].startswith('{"symbol":"A","action":"buy","price":null,"stop":1.0')


def test_surveillance(spark):
    asm = {"longterm": {"data": [{"symbol": "AAA", "asmSurvIndicator": "I"}, {"symbol": None}]}, "shortterm": {"data": [{"symbol": "bbb", "asmSurvIndicator": "II"}]}}
    raw = spark.createDataFrame([(D(2024, 1, 1), json.dumps(asm), json.dumps([{"symbol": "CCC", "gsmStage": "III"}]))], "fetch_date date, asm string, gsm string")
    out = sorted((r["symbol"], r["list_type"], r["stage"]) for r in readers.flatten_surveillance(raw).collect())
    assert out == [("AAA", "ASM-LT", "I"), ("BBB", "ASM-ST", "II"), ("CCC", "GSM", "III")]
    flags = pit.latest_flags(readers.flatten_surveillance(raw))
    signals = spark.createDataFrame([("AAA", "buy"), ("CCC", "sell"), ("D", "hold")], "symbol string, action string")
    assert sorted((r["symbol"], r["surveillance"], r["warn"]) for r in selection.annotate(signals, flags).collect()) == [("AAA", "ASM-LT I", True), ("CCC", "GSM III", False), ("D", None, False)]


def test_universe_aliases(spark):
    raw = spark.createDataFrame([(" aaa.NS ", "Alpha", "EQ", "Tech"), ("B", "Beta", "BE", "Tech"), (None, "x", "EQ", "y")], "Symbol string, `Company Name` string, Series string, Industry string")
    assert [tuple(r) for r in readers.normalize_universe(raw).collect()] == [("AAA", "Alpha", "Tech", None)]


def test_snapshot_date_defaults_to_latest_bar(spark):
    out = readers.with_snapshot_date(spark.createDataFrame([("A",)], "symbol string"), bars(spark, [1, 2, 3])).first()
    assert out["snapshot_date"] == days(3)[-1]


def test_indicators_equal_pandas(spark):
    rng = np.random.default_rng(4)
    close = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.015, 700))))
    df = bars(spark, close, spread=0.5)
    out = indicators.macd(indicators.adx(indicators.atr(indicators.rsi(indicators.ema(df, "close", 20)))))
    got = out.orderBy("date").toPandas()
    ema = lambda x, a, n: x.ewm(alpha=a, adjust=False, min_periods=n).mean()
    diff = close.diff()
    gain, loss = ema(diff.clip(lower=0), 1 / 14, 14), ema((-diff).clip(lower=0), 1 / 14, 14)
    np.testing.assert_allclose(got["rsi14"], 100 - 100 / (1 + gain / loss), rtol=1e-9)
    np.testing.assert_allclose(got["ema20"], close.ewm(span=20, adjust=False, min_periods=20).mean(), rtol=1e-9)
    high, low, before = close + 0.5, close - 0.5, close.shift(1)
    tr = pd.Series(np.maximum.reduce([high - low, (high - before).abs(), (low - before).abs()]))
    np.testing.assert_allclose(got["atr14"], ema(tr, 1 / 14, 14), rtol=1e-9)
    line = ema(close, 2 / 13, 12) - ema(close, 2 / 27, 26)
    np.testing.assert_allclose(got["macd"], line, atol=1e-9)
    np.testing.assert_allclose(got["macd_signal"], line.dropna().ewm(span=9, adjust=False, min_periods=9).mean().reindex(line.index), atol=1e-9)


def test_rsi_without_losses_or_moves(spark):
    up = indicators.rsi(bars(spark, range(1, 30))).orderBy("date").toPandas()["rsi14"]
    assert up[:14].isna().all() and (up[14:] == 100).all()
    assert indicators.rsi(bars(spark, [5] * 30)).filter("rsi14 is not null").count() == 0


def test_nothing_looks_ahead(spark, sf):
    b, cut = fx.bars(spark, sf), D(1998, 6, 30)
    past = b.filter(F.col("date") <= F.lit(cut))
    spec = StrategySpec(features=("sma50", "roc21", "rsi14"), filters=("close > sma50", "rsi14 < 90"))
    key = lambda df: sorted(tuple(r) for r in df.filter(F.col("date") <= F.lit(cut)).select("symbol", "date", "position").collect())
    full = key(selections(spec, b, fx.sectors(spark, sf)))
    assert full and full == key(selections(spec, past, fx.sectors(spark, sf)))


def test_strategy_evaluation_runs(spark, sf):
    out = evaluate(StrategySpec(stop=("pct", 0.2), target=("r", 3.0), max_weight=0.2, weighting="inverse_vol"), fx.bars(spark, sf), fx.sectors(spark, sf))
    assert out["summary"].count() == 1 and out["trades"].filter("exit is null or entry is null").count() == 0


def test_split_is_found_and_crash_is_not(spark):
    split = bars(spark, [100] * 20 + [10] * 20, "S")
    crash = bars(spark, [100] * 20 + [40] * 20, "C")
    shares = spark.createDataFrame([("S", D(2020, 1, 1), 1.0), ("S", D(2020, 4, 30), 10.0), ("C", D(2020, 1, 1), 1.0), ("C", D(2020, 4, 30), 1.0)], "symbol string, date date, shares double")
    gaps = actions.gap_candidates(split.union(crash))
    events = actions.confirm_actions(gaps, actions.share_steps(shares))
    assert [(r["symbol"], r["ratio"]) for r in events.collect()] == [("S", 10.0)]
    first = split.groupBy("symbol").agg(F.min("date").alias("first_date"))
    factors = sorted(r["factor"] for r in actions.adjustment_factors(events, first).collect())
    assert factors == [0.1, 1.0]
    ended = actions.delistings(split.union(crash), split.union(crash), events, gaps, spark.createDataFrame([("S", 5.0)], "symbol string, mcap double"))
    assert {r["symbol"]: r["ca_uncertain"] for r in ended.collect()} == {"S": False, "C": True}


def test_reverse_split_keeps_direction(spark):
    df = spark.createDataFrame([(0.1,), (2.02,), (1.1,)], "g double")
    assert [r[0] for r in df.select(actions.snap_ratio(F.col("g"), 0.05)).collect()] == [0.1, 2.0, None]


def test_sums_added_in_another_order_are_one_count(spark):
    """Both tables hold one sum of 0.1, 0.2 and 0.3, each added in an order of its own; another value stays a row of its own."""
    table = lambda np: spark.createDataFrame([(1, D(2020, 3, 31), "NP", np), (1, D(2020, 3, 31), "EPS", 3.0)], "id int, date date, metric string, value double")
    one, other = (0.1 + 0.2) + 0.3, 0.1 + (0.2 + 0.3)
    assert one != other
    assert [r["shares"] for r in actions.shares_history(table(one), table(other), digits=6).collect()] == [pytest.approx(0.2)]
    assert actions.shares_history(table(one), table(0.7), digits=6).count() == 2


def test_rename_is_not_a_death(spark):
    rows = [("OLD", "I1", D(2020, 1, 1)), ("NEW", "I1", D(2021, 1, 1)), ("GONE", "I2", D(2020, 1, 1)), ("NEW2", "I3", D(2021, 1, 1))]
    df = spark.createDataFrame([(s, i, d, 1e6, 1e6) for s, i, d in rows], "symbol string, isin string, date date, close double, volume double")
    out = {r["symbol"]: (r["status"], r["renamed_to"]) for r in actions.classify_ended(df, df.filter("symbol = 'X'"), "2020-06-01").collect()}
    assert out == {"OLD": ("renamed", "NEW"), "GONE": ("dead", None)}


def test_fill_does_not_revive(spark):
    m = spark.createDataFrame([("A", d, 10.0) for d in days(3)], "symbol string, date date, mcap double")
    calendar = spark.createDataFrame([(d,) for d in days(20)], "date date")
    assert pit.membership_panel(m, calendar, 5.0).filter("member").count() == 3 + 10


@pytest.mark.parametrize("c, s, want", [(4, 12, True), (0, 12, True), (11, 12, False), (3, 3, False), (5, 4, False), (6, 12, False)])
def test_basis_rule(spark, c, s, want):
    assert spark.range(1).select(fundamentals.prefer_standalone(F.lit(c), F.lit(s))).first()[0] is want


def test_ratios_of_odd_balance_sheets(spark):
    rows = []
    for sym, equity, borrow in (("zero", -0.04, 0.04), ("negative", -0.07, 0.06), ("fine", 100.0, 50.0)):
        for section, label, v in (("balance-sheet", "Equity Capital", equity), ("balance-sheet", "Borrowings", borrow), ("profit-loss", "Profit before tax", 5.0), ("profit-loss", "Interest", 1.0)):
            rows.append((sym, "consolidated", D(2024, 3, 31), section, label, v))
    df = spark.createDataFrame(rows, "symbol string, basis string, period_end date, section string, label string, value double")
    out = {r["symbol"]: r["roce"] for r in fundamentals.statement_ratios(df).collect()}
    assert out["zero"] is None and out["negative"] is None and out["fine"] == pytest.approx(4.0)


def test_cap_equals_the_iterative_rule(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for b in range(60):
        w = rng.dirichlet(np.ones(int(rng.integers(1, 9)))) * rng.choice([1.0, 0.9])
        cap = 0.3
        rows += [(b, f"s{i}", float(x)) for i, x in enumerate(w)]
        x = w.copy()
        for _ in range(100):
            over = x > cap + 1e-15
            excess, free = (x[over] - cap).sum(), x < cap - 1e-12
            x[over] = cap
            if excess < 1e-15 or not free.any():
                break
            x[free] += excess / free.sum()
        want |= {(b, f"s{i}"): v for i, v in enumerate(x)}
    out = selection.cap_weights(spark.createDataFrame(rows, "date int, symbol string, weight double"), 0.3)
    for r in out.collect():
        assert r["weight"] == pytest.approx(want[r["date"], r["symbol"]], abs=1e-9)


def spans(spark, rows):
    return spark.createDataFrame(rows, "symbol string, entry_date date, exit_date date, exit_reason string, stop double, target double")


def test_first_touch_rules(spark):
    d = days(6)
    rows = [("G", 0, 100, 101, 99, 100), ("G", 1, 80, 85, 79, 84), ("G", 2, 84, 200, 84, 90), ("T", 0, 100, 101, 99, 100), ("T", 1, 100, 130, 80, 100), ("T", 2, 100, 100, 100, 100)]
    df = spark.createDataFrame([(s, d[i], *map(float, v), 1.0) for s, i, *v in rows], "symbol string, date date, open double, high double, low double, close double, atr double")
    sp = spans(spark, [("G", d[0], d[2], "end", 90.0, 120.0), ("T", d[0], d[2], "end", 90.0, 120.0)])
    out = {r["symbol"]: (r["exit"], r["exit_reason"], r["exit_date"]) for r in outcomes.first_touch(sp, df).collect()}
    assert out == {"G": (80.0, "stop", d[1]), "T": (90.0, "stop", d[1])}  # a gap fills at the open; of both levels the stop wins
    timed = outcomes.first_touch(spans(spark, [("T", d[0], d[2], "end", 1.0, 999.0)]), df, max_hold=1).first()
    assert (timed["exit_reason"], timed["exit_date"]) == ("time", d[1])
    trail = outcomes.first_touch(spans(spark, [("G", d[0], d[2], "end", 1.0, 999.0)]), df, trailing=5.0).first()
    assert (trail["exit_reason"], trail["exit"]) == ("stop", 80.0)


def test_positions_of_one_symbol_and_day_are_trades_of_their_own(spark, sf):
    import __spark_entry__ as entry
    from pitpanel.plans import fixtures

    d = days(3)
    sp = spark.createDataFrame([(i, "X", d[0], d[2], "end", stop, 99.0) for i, stop in ((1, 9.5), (2, 1.0))], "position_id long, symbol string, entry_date date, exit_date date, exit_reason string, stop double, target double")
    df = bars(spark, [10, 9, 8], "X")
    t = outcomes.first_touch(sp, df, keys=["position_id"])
    assert {r["position_id"]: (r["exit_date"], r["exit_reason"]) for r in t.collect()} == {1: (d[1], "stop"), 2: (d[2], "end")}
    nav = outcomes.nav_series(t.withColumn("weight", F.lit(0.5)), df, 1.0, buy_rate=0, sell_rate=0, trade=["position_id"]).orderBy("date").collect()
    assert [(r["ret"], r["exposure"]) for r in nav] == [pytest.approx(x) for x in ((0, 1), (-0.1, 1), (-1 / 18, 0.5))]
    out = entry.queries()["i2_i4_first_touch_all"](spark, sf)
    assert out.count() == fixtures.positions(spark, sf).count()


def test_whole_tables_reach_entry_context_and_metric_panel(spark, sf):
    import __spark_entry__ as entry
    from pitpanel.plans import fixtures

    q = entry.queries()
    assert q["h15_entry_context_all"](spark, sf).count() == fixtures.sectors(spark, sf).count()
    ids = fixtures.eav(spark, sf).filter("metric = 'NP'").select("id").distinct().count()
    assert q["b11_metric_panel_all"](spark, sf).select("symbol").distinct().count() == ids


def test_delisted_trades_end_at_the_last_close(spark):
    live, dead = bars(spark, [10] * 10, "L"), bars(spark, [10, 9, 8], "X")
    sp = spans(spark, [("X", days(1)[0], days(10)[-1], "end", 0.0, 99.0)])
    out = outcomes.first_touch(sp, live.union(dead), delisted=True).first()
    assert (out["exit"], out["exit_reason"], out["exit_date"]) == (8.0, "delisted", days(3)[-1])


def test_costs_only_lower_returns(spark):
    df = spark.createDataFrame([(100.0, 110.0, 10), (100.0, 95.0, 0)], "entry double, exit double, shares int").withColumn("entry_date", F.lit("2020-01-01").cast("date")).withColumn("exit_date", F.lit("2020-02-01").cast("date"))
    by = [sorted(r["return_pct"] for r in outcomes.trade_outcomes(df, m).collect()) for m in (0.0, 1.0, 2.0)]
    assert all(a > b > c for a, b, c in zip(*by, strict=True))


def test_performance_goldens(spark):
    curve = spark.createDataFrame([("v", d, float(x)) for d, x in zip(days(5), [100, 120, 60, 90, 150], strict=True)], "variant string, date date, nav double")
    assert performance.returns_summary(curve).first()["max_drawdown"] == pytest.approx(-0.5)
    worst = performance.max_drawdown(curve).first()
    assert (worst["peak_date"], worst["trough_date"]) == (days(5)[1], days(5)[2])
    trades = spark.createDataFrame([("v", 0.1, 1), ("v", 0.2, 2), ("v", -0.1, 3)], "variant string, return_pct double, holding_days int")
    stats = performance.trade_stats(trades).first()
    assert stats["win_rate"] == pytest.approx(2 / 3) and stats["profit_factor"] == pytest.approx(3.0)
    one = performance.returns_summary(curve.limit(1)).first()
    assert one["cagr"] == one["sharpe"] == 0.0


def test_bar_stream_is_idempotent(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    frame = lambda close, at: spark.createDataFrame([("A", D(2020, 1, 1), close, at), ("A", D(2021, 1, 1), close, at)], "symbol string, date date, close double, ingested_at string").selectExpr(
        "symbol", "date", "close as open", "close as high", "close as low", "close", "1.0D as volume", "cast(ingested_at as timestamp) as ingested_at"
    )
    for n, (close, at) in enumerate([(1.0, "2020-01-01"), (2.0, "2020-01-03"), (1.5, "2020-01-02"), (2.0, "2020-01-03")]):
        frame(close, at).write.mode("append").parquet(src)
        jobs.stream_bars(spark, src, dst, str(tmp_path / "ckpt")).awaitTermination()
        got = sorted((r["date"].year, r["close"]) for r in spark.read.parquet(dst).collect())
        assert got == [(2020, [1.0, 2.0, 2.0, 2.0][n]), (2021, [1.0, 2.0, 2.0, 2.0][n])]


def test_alert_stream_says_each_hit_once(spark, tmp_path):
    src = str(tmp_path / "bars")
    rows = [("A", "2020-01-01 10:00:00", 89.0), ("A", "2020-01-01 11:00:00", 88.0), ("A", "2020-02-20 11:00:00", 88.0), ("A", "2020-01-02 10:00:00", 130.0), ("B", "2020-01-01 10:00:00", 100.0)]
    spark.createDataFrame(rows, "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    positions = spark.createDataFrame([("p1", "A", 90.0, 120.0, "open"), ("p2", "B", 90.0, 120.0, "open")], "position_id string, symbol string, stop double, target double, status string")
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(src)
    q = jobs.stream_alerts(stream, positions).writeStream.format("memory").queryName("alerts_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["position_id"], r["reason"]) for r in spark.table("alerts_seen").collect()) == [("p1", "stop_hit"), ("p1", "target_hit")]


def test_alert_stream_meets_first_bars_beyond_levels(spark):
    """What goes on to meet positions are new lows and highs only, in whatever order bars come, and they hit every level that any bar hits, first."""
    import random

    import pandas as pd

    rng = random.Random(3)
    rows = [(s, pd.Timestamp(2020, 1, 1) + pd.Timedelta(minutes=t), float(rng.randint(50, 150))) for s in "ab" for t in range(500)]
    mixed = pd.DataFrame(rng.sample(rows, len(rows)), columns=["symbol", "ts", "close"])
    got = pd.concat(jobs._records((mixed[i::7] for i in range(7)), least=200))
    assert len(got) < 60
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        for level in range(50, 150, 7):
            mine = got[(got["symbol"] == s) & (got["close"] <= level) & ~(got["lowest"] <= level)]
            first = next(r for r in own if r[2] <= level) if any(r[2] <= level for r in own) else None
            assert [(r.ts, r.close) for r in mine.itertuples()] == ([first[1:]] if first else [])


def test_alerts_follow_many_symbols_by_one_call():
    """A call and a list in the state hold all symbols of a group, in batches of any cut, and equal positions looked at one by one."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    rng, kept = random.Random(5), []
    levels = jobs._Levels()
    levels.init(SimpleNamespace(getListState=lambda *_: SimpleNamespace(get=lambda: iter(kept), put=lambda rows: kept.__setitem__(slice(None), rows), clear=kept.clear)))
    symbols, columns = [f"s{k}" for k in range(12)], ["symbol", "at", "close", "position_id", "status", "stop", "target"]
    # ids are those of one symbol, others have the same
    spans = {(s, f"p{k}"): (a := rng.randint(0, 99), rng.choice([None, a + rng.randint(1, 80)]), rng.choice([None, rng.uniform(40, 70)]), rng.uniform(80, 110)) for s in symbols for k in range(6)}
    closes = {(s, t): rng.choice([float("nan"), *[rng.uniform(40, 110)] * 9]) for s in symbols[1:] for t in rng.sample(range(200), 60)}
    got = []
    for lo, hi in ((0, 70), (70, 71), (71, 300)):
        news = [(s, t, c, None, None, None, None) for (s, t), c in closes.items() if lo <= t < hi]
        news += [(s, a, None, p, "open", stop, target) for (s, p), (a, _, stop, target) in spans.items() if lo <= a < hi]
        news += [(s, z, None, p, "closed", None, None) for (s, p), (_, z, _, _) in spans.items() if z is not None and lo <= z < hi]
        frame = pd.DataFrame(rng.sample(news, len(news)), columns=columns).astype({"close": float, "stop": float, "target": float})
        out = pd.concat(levels.handleInputRows((0, 0), iter([frame[::2], frame[1::2]]), None))
        got += [tuple(r) for r in out[["symbol", "position_id", "reason", "price", "at"]].itertuples(index=False)]
    want = set()
    for (s, p), (a, z, stop, target) in spans.items():
        own = sorted((t, c) for (x, t), c in closes.items() if x == s and a <= t and (z is None or t < z))
        below = lambda c: stop is not None and c <= stop
        for reason, hit in (("stop_hit", below), ("target_hit", lambda c: c >= target and not below(c))):
            want |= {(s, p, reason, c, t) for t, c in [r for r in own if hit(r[1])][:1]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert {r[:2] for r in kept} == {k for k, v in spans.items() if v[1] is None}


def test_alerts_follow_positions(spark, tmp_path):
    """A position closed midway frees its state and is silent; another opened midway is seen; what was said isn't said again."""
    prices, events = str(tmp_path / "bars"), str(tmp_path / "positions")
    bar = lambda *rows: spark.createDataFrame(list(rows), "symbol string, ts string, close double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(prices)
    change = lambda *rows: spark.createDataFrame(list(rows), "position_id string, symbol string, ts string, status string, stop double, target double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(events)
    stream = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def run(n, shares):
        writer = jobs.follow_alerts(stream(prices), stream(events), shares).writeStream.format("parquet").option("path", f"{tmp_path}/out{shares}").option("checkpointLocation", f"{tmp_path}/c{shares}")
        query = jobs.start_with_state(spark, writer.outputMode("append").trigger(availableNow=True))
        query.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        got = spark.read.schema(jobs.ALERT_SCHEMA).parquet(f"{tmp_path}/out{shares}").collect()
        assert len(got) == n
        return {(r["position_id"], r["reason"], r["price"], str(r["ts"])[:10]) for r in got}, state[-1]

    change(("early", "A", "2020-01-01", "open", 90.0, 120.0), ("idle", "A", "2020-01-01", "open", 1.0, None), ("other", "B", "2020-01-01", "open", 90.0, 120.0))
    bar(("A", "2019-12-31", 50.0), ("A", "2020-01-03", 121.0), ("A", "2020-01-02", 130.0), ("B", "2020-01-02", 100.0), ("B", "2020-01-02", None))
    first = {("early", "target_hit", 130.0, "2020-01-02")}
    for shares in (1, 3):
        assert run(1, shares)[0] == first
    change(("early", "A", "2020-01-10", "closed", None, None), ("late", "A", "2020-01-08", "open", 95.0, 200.0), ("other", "B", "2020-01-09", "closed", None, None))
    bar(("A", "2020-01-07", 94.0), ("A", "2020-01-09", 91.0), ("A", "2020-01-10", 80.0), ("B", "2020-01-09", 10.0), ("A", "2020-01-11", 140.0))
    for shares in (1, 3):
        assert run(2, shares)[0] == first | {("late", "stop_hit", 91.0, "2020-01-09")}
    change(("idle", "A", "2020-02-01", "closed", None, None), ("late", "A", "2020-02-01", "closed", None, None))
    bar(("A", "2020-02-02", 0.5), ("A", "2020-01-20", 201.0))
    seen, left = run(3, 1)
    assert seen == first | {("late", "stop_hit", 91.0, "2020-01-09"), ("late", "target_hit", 201.0, "2020-01-20")} and left == 0


def test_percent_rank_equals_pandas(spark):
    values = [1.0, 2.0, 2.0, 4.0, 5.0, None]
    df = spark.createDataFrame([(D(2020, 1, 1), f"s{i}", v) for i, v in enumerate(values)], "date date, symbol string, v double")
    out = df.select("symbol", selection.pct_rank("v").alias("p")).orderBy("symbol").toPandas()["p"]
    np.testing.assert_allclose(out, pd.Series(values).rank(pct=True))


def test_densify_modes(spark):
    df = bars(spark, [1, 2, 3], "A").union(bars(spark, [1], "B", str(days(6)[-1])))
    assert panel.densify(df).count() == 8 and panel.densify(df, bounded=True).count() == 4


def test_taken_events_leave_the_others_to_match(spark):
    """A prediction whose nearest truth is taken gets the other one in reach; the same for truths; equal rows count once."""
    at = lambda *ns: spark.createDataFrame([("A", D(2020, 1, n), 2.0) for n in ns], "symbol string, date date, ratio double")
    for p, t, tp in (((5, 6), (6, 8), 2), ((5, 6), (4, 6), 2), ((5, 7, 9), (6, 8, 10), 3), ((5,), (6, 4), 1), ((5, 25), (20,), 0), ((5, 6, 7), (6,), 1)):
        out = actions.match_events(at(*p), at(*t)).first()
        assert (out["tp"], out["fp"], out["fn"]) == (tp, len(p) - tp, len(t) - tp)
    other = at(5).withColumn("ratio", F.lit(3.0))
    assert actions.match_events(at(5), other).first()["tp"] == 0 and actions.match_events(at(5), other.limit(0)).first()["fp"] == 1


def test_long_exponential_means_equal_pandas(spark):
    """Several blocks, blocks beyond 4096 rows, and a mean that forgets everything."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=1200)
    day = pd.date_range("1990-01-01", periods=len(x)).date
    df = spark.createDataFrame([("s", d, None if i < 3 else float(v)) for i, (d, v) in enumerate(zip(day, x, strict=True))], "symbol string, date date, close double")
    for alpha in (0.01, 0.1, 0.4, 0.9, 1.0, 1e-4):
        got = indicators.ewm(df, {"y": "close"}, alpha).orderBy("date").toPandas()["y"].to_numpy(float)
        want = pd.Series(np.where(np.arange(len(x)) < 3, np.nan, x)).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_entry_module_hides_no_import_error(tmp_path):
    """Without the corpus operators the rest imports; an error inside them isn't hidden."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/pitpanel", tmp_path / "pitpanel", ignore=lambda d, names: ["llm"] if d == f"{root}/pitpanel" else [])
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(run().stdout) > 150
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    assert run().returncode

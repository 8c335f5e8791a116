"""Outcomes of selections as sets of independent entries: spans, exits, returns, books, sweeps and walk-forward windows.

No cash is shared between entries, so nothing runs day by day. Variants of a strategy are rows with a variant key; every function
takes them along in `keys`, so a sweep is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .performance import window_summaries
from .pit import asof_join
from .selection import BUY_RATE, SELL_FLAT, SELL_RATE


def holding_spans(selections: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """symbol, entry_date, exit_date, exit_reason of runs of consecutive rebalances.

    selections (keys, symbol, date) lie on rebalance dates; calendar (date) has all trading dates. Entry is the trading date after the
    first selection, exit the one after the first rebalance without it ("rebalance") or the last date ("end").
    """
    days = calendar.select("date").distinct()
    after = days.withColumn("_next", F.lead("date").over(Window.orderBy("date")))  # one row a trading date
    rebalances = selections.select(*keys, "date").distinct()
    numbered = rebalances.withColumn("_no", F.row_number().over(_by(keys).orderBy("date")))
    numbered = numbered.withColumn("_then", F.lead("date").over(_by(keys).orderBy("date")))
    own = selections.select(*keys, "symbol", "date").join(numbered, [*keys, "date"])
    island = F.col("_no") - F.row_number().over(Window.partitionBy(*keys, "symbol").orderBy("date"))
    runs = own.withColumn("_island", island).groupBy(*keys, "symbol", "_island").agg(
        F.min("date").alias("_first"), F.max_by("_then", "date").alias("_drop")
    )
    entry = F.broadcast(after.select(F.col("date").alias("_first"), F.col("_next").alias("entry_date")))
    leave = F.broadcast(after.select(F.col("date").alias("_drop"), F.col("_next").alias("_exit")))
    end = F.broadcast(days.agg(F.max("date").alias("_end")))
    joined = runs.join(entry, "_first").filter("entry_date is not null").join(leave, "_drop", "left").join(end)
    return joined.select(
        *keys,
        "symbol",
        "entry_date",
        F.coalesce("_exit", "_end").alias("exit_date"),
        F.when(F.col("_exit").isNotNull(), "rebalance").otherwise("end").alias("exit_reason"),
    )


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def delisting_dates(bars: DataFrame) -> DataFrame:
    """symbol, last_date, last_close of symbols whose bars end before the data do."""
    last = bars.filter("close is not null").groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
    return last.join(F.broadcast(bars.agg(F.max("date").alias("_end")))).filter("last_date < _end").drop("_end")


def first_touch(
    spans: DataFrame, bars: DataFrame, entry_day: bool = True, max_hold: int | None = None, trailing: float | None = None,
    delisted: bool = False, peak_today: bool = False, keys: Sequence[str] = (),
) -> DataFrame:
    """spans with entry, exit, exit_date and exit_reason after stops, targets, time and delisting.

    spans (keys, symbol, entry_date, exit_date, exit_reason, stop, target) meet the bars of their symbol between entry and exit; of
    what happens the earliest day counts, and on one day stop, then target, then time, then the planned exit. A gap through a level
    fills at the open. trailing is the ATR multiple (bars need atr) under the running peak, through yesterday unless peak_today. With
    entry_day=False (fills at the close) the entry's own bar can't exit. max_hold counts calendar days, at least so many.

    Stops and targets that stay where they are go by months: a symbol's month is one row of its extremes and its days, at most 31, and
    a span meets the months that it reaches into. One join and one grouping give all events; days are looked at for levels only where the
    extremes reach one. bars may bring the number of their month (month_number) as `month`. A trailing stop depends on
    every day since the entry, so there a span meets them all.
    """
    if trailing is None:
        return _by_months(spans, bars, entry_day, max_hold, delisted, keys)
    span = [*keys, "symbol", "entry_date"]
    b = bars.select(F.col("symbol").alias("_symbol"), "date", "open", "high", "low", "close", "atr")
    over = spans.join(b, (F.col("symbol") == F.col("_symbol")) & F.col("date").between(F.col("entry_date"), F.col("exit_date")))
    if delisted:
        gone = delisting_dates(bars).select(F.col("symbol").alias("_gone"), "last_date")
        over = over.join(gone, over["symbol"] == gone["_gone"], "left").drop("_gone")
    run = Window.partitionBy(*span).orderBy("date")
    peak = F.max("high").over(run.rowsBetween(Window.unboundedPreceding, 0 if peak_today else -1))
    over = over.withColumn("_level", F.coalesce(peak, F.when(F.lit(peak_today), F.col("high"))) - F.col("atr") * trailing)
    ratchet = F.max("_level").over(run.rowsBetween(Window.unboundedPreceding, 0))
    over = over.withColumn("_stop", F.greatest("stop", ratchet))
    stop = F.col("_stop")
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    live = whole if entry_day else whole & (F.col("date") > F.col("entry_date"))
    hit_stop = live & (F.col("low") <= stop)
    hit_target = live & (F.col("high") >= F.col("target"))
    at_stop, at_target = _fills(stop, F.col("target"), F.col("open"))
    timed = live & (F.datediff("date", "entry_date") >= max_hold) if max_hold else F.lit(False)
    ended = F.col("date") == F.col("last_date") if delisted else F.lit(False)
    planned = F.col("date") == F.col("exit_date")
    by_plan = F.when(F.col("exit_reason") == "rebalance", F.coalesce("open", "close")).otherwise(F.col("close"))
    event = lambda when, priority, price, reason: _event(when, F.col("date"), priority, price, reason)
    # A planned exit at the open comes before the day's range.
    opens = planned & (F.col("exit_reason") == "rebalance")
    first = F.array_min(
        F.array_compact(
            F.array(
                event(opens, 0, by_plan, F.col("exit_reason")),
                event(hit_stop, 1, at_stop, F.lit("stop")),
                event(hit_target, 2, at_target, F.lit("target")),
                event(timed, 3, F.col("close"), F.lit("time")),
                event(ended, 4, F.col("close"), F.lit("delisted")),
                event(planned & ~opens, 5, by_plan, F.col("exit_reason")),
                # no bar on the planned date: the last bar before it
                event(F.lead("date").over(run).isNull(), 6, F.col("close"), F.col("exit_reason")),
            )
        )
    )
    found = over.withColumn("_event", first).groupBy(*span).agg(
        F.min("_event").alias("x"), F.min_by("open", F.when(F.col("date") == F.col("entry_date"), F.col("date"))).alias("entry")
    )
    return _with_exits(spans, found, span)


def _event(when: Column, date: Column, priority: int, price: Column, reason: Column) -> Column:
    return F.when(when, F.struct(date.alias("d"), F.lit(priority).alias("p"), price.alias("price"), reason.alias("reason")))


def _fills(stop: Column, target: Column, opened: Column) -> tuple[Column, Column]:
    """What a stop and a target fill at: their level, or the open where it is beyond the level."""
    return F.when(opened.isNull() | (opened >= stop), stop).otherwise(opened), F.when(opened.isNull() | (opened <= target), target).otherwise(opened)


def _with_exits(spans: DataFrame, found: DataFrame, span: Sequence[str]) -> DataFrame:
    rest = [c for c in spans.columns if c not in (*span, "exit_date", "exit_reason", "entry")]
    return spans.select(*span, *rest).join(found, list(span)).select(
        *span, *rest, "entry", F.col("x.d").alias("exit_date"), F.col("x.price").alias("exit"), F.col("x.reason").alias("exit_reason")
    )


def month_number(date: str) -> Column:
    return F.year(date) * 12 + F.month(date)


def touchable_days(spans: DataFrame, bars: DataFrame, span: Sequence[str]) -> DataFrame:
    """Spans (with stop, target and exit_date) beside the bars of those of their months whose extremes reach a level.

    Months after the first that lies whole within the span and reaches one are left out, as one of its days touches for sure.
    """
    zones = bars.groupBy(F.col("symbol").alias("_symbol"), month_number("date").alias("_month")).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    months = spans.select(*span, "exit_date", "stop", "target", F.explode(F.sequence(month_number("entry_date"), month_number("exit_date"))).alias("_m"))
    reached = months.join(zones, (F.col("symbol") == F.col("_symbol")) & (F.col("_m") == F.col("_month"))).filter("_low <= stop or _high >= target")
    sure = (F.col("_m") > month_number("entry_date")) & (F.col("_m") < month_number("exit_date"))
    reached = reached.withColumn("_sure", F.min(F.when(sure, F.col("_m"))).over(Window.partitionBy(*span))).filter("_sure is null or _m <= _sure")
    reached = reached.drop("_symbol", "_month", "_low", "_high", "_sure")
    days = bars.select(F.col("symbol").alias("_symbol"), month_number("date").alias("_month"), "date", "open", "high", "low", "close")
    met = reached.join(days, (F.col("symbol") == F.col("_symbol")) & (F.col("_m") == F.col("_month")))
    return met.filter("date between entry_date and exit_date").drop("_symbol", "_month", "_m")


def _by_months(spans: DataFrame, bars: DataFrame, entry_day: bool, max_hold: int | None, delisted: bool, keys: Sequence[str]) -> DataFrame:
    span = [*keys, "symbol", "entry_date"]
    month = F.col("month") if "month" in bars.columns else month_number("date")
    day = F.struct("date", "open", "high", "low", "close")
    whole = lambda x: x["high"].isNotNull() & x["low"].isNotNull() & x["close"].isNotNull()
    full = whole({c: F.col(c) for c in ("high", "low", "close")})
    months = bars.groupBy(F.col("symbol").alias("_symbol"), month.alias("_month")).agg(
        F.min(F.when(full, F.col("low"))).alias("_low"), F.max(F.when(full, F.col("high"))).alias("_high"), F.collect_list(day).alias("_days")
    )
    own = spans.drop("entry").filter("entry_date <= exit_date")
    asked = own.select(*span, "exit_date", "stop", "target", F.explode(F.sequence(month_number("entry_date"), month_number("exit_date"))).alias("_m"))
    met = asked.join(months, (F.col("symbol") == F.col("_symbol")) & (F.col("_m") == F.col("_month")))
    met = met.withColumn("_days", F.filter("_days", lambda x: x["date"].between(F.col("entry_date"), F.col("exit_date"))))
    stop, target = F.col("stop"), F.col("target")

    def touch(x: Column) -> Column:
        at_stop, at_target = _fills(stop, target, x["open"])
        return F.coalesce(
            _event(x["low"] <= stop, x["date"], 1, at_stop, F.lit("stop")), _event(x["high"] >= target, x["date"], 2, at_target, F.lit("target"))
        )

    live = lambda x: whole(x) if entry_day else whole(x) & (x["date"] > F.col("entry_date"))
    reached = (F.col("_low") <= stop) | (F.col("_high") >= target)
    found = {
        "_touched": F.min(F.when(reached, F.array_min(F.transform(F.filter("_days", live), touch)))),
        # the last day in reach, on the planned date or before it
        "_end": F.max(F.array_max(F.transform("_days", lambda x: F.struct(x["date"].alias("date"), x["open"].alias("open"), x["close"].alias("close"))))),
        "entry": F.max(F.get(F.filter("_days", lambda x: x["date"] == F.col("entry_date")), 0)["open"]),
    }
    if max_hold:
        due = lambda x: whole(x) & (F.datediff(x["date"], "entry_date") >= max_hold)
        found["_timed"] = F.min(F.array_min(F.transform(F.filter("_days", due), lambda x: F.struct(x["date"].alias("date"), x["close"].alias("close")))))
    found = met.groupBy(*span).agg(*[c.alias(name) for name, c in found.items()]).filter("_end is not null")
    last = own.join(found, span)
    planned, rebalanced = F.col("_end.date") == F.col("exit_date"), F.col("exit_reason") == "rebalance"
    events = [
        F.col("_touched"),
        _event(planned & rebalanced, F.col("_end.date"), 0, F.coalesce("_end.open", "_end.close"), F.col("exit_reason")),
        _event(planned & ~rebalanced, F.col("_end.date"), 5, F.col("_end.close"), F.col("exit_reason")),
        _event(~planned, F.col("_end.date"), 6, F.col("_end.close"), F.col("exit_reason")),
    ]
    if max_hold:
        events.append(_event(F.col("_timed").isNotNull(), F.col("_timed.date"), 3, F.col("_timed.close"), F.lit("time")))
    if delisted:
        gone = delisting_dates(bars).select("symbol", F.col("last_date").alias("_gone"), F.col("last_close").alias("_gone_close"))
        last = last.join(gone, "symbol", "left")
        events.append(_event(F.col("_gone").between(F.col("entry_date"), F.col("exit_date")), F.col("_gone"), 4, F.col("_gone_close"), F.lit("delisted")))
    x = F.array_min(F.array_compact(F.array(*events)))
    rest = [c for c in spans.columns if c not in (*span, "exit_date", "exit_reason", "entry")]
    return last.withColumn("x", x).select(
        *span, *rest, "entry", F.col("x.d").alias("exit_date"), F.col("x.price").alias("exit"), F.col("x.reason").alias("exit_reason")
    )


def trade_outcomes(exits: DataFrame, cost_mult: float = 1.0, buy_rate: float = BUY_RATE, sell_rate: float = SELL_RATE, flat: float = SELL_FLAT) -> DataFrame:
    """Adds return_pct net of fees on both sides, r_multiple (risk > 0) and holding_days; shares spreads the flat fee, if there."""
    per_share = F.try_divide(F.lit(flat * cost_mult), F.nullif("shares", F.lit(0))) if "shares" in exits.columns else F.lit(0.0)
    paid = F.col("entry") * (1 + buy_rate * cost_mult)
    got = F.col("exit") * (1 - sell_rate * cost_mult) - F.coalesce(per_share, F.lit(0.0))
    r = F.when(F.col("risk") > 0, (F.col("exit") - F.col("entry")) / F.col("risk")) if "risk" in exits.columns else F.lit(None).cast("double")
    return exits.withColumns(
        {
            "return_pct": F.when(paid > 0, got / paid - 1).otherwise(0.0),
            "r_multiple": r,
            "holding_days": F.datediff("exit_date", "entry_date"),
        }
    )


def nav_series(
    trades: DataFrame, bars: DataFrame, capital: float, keys: Sequence[str] = (), buy_rate: float = BUY_RATE, sell_rate: float = SELL_RATE,
    trade: Sequence[str] = (),
) -> DataFrame:
    """date, ret, exposure, nav: the sum of weight times a day's return over open trades, less costs on entry and exit days.

    A trade earns from its entry price on its first day to its exit price on its last, and close to close between.
    keys tell books apart, trade tells apart the trades of one symbol and entry date within a book.
    """
    b = bars.select(F.col("symbol").alias("_symbol"), "date", "close")
    held = trades.join(b, (F.col("symbol") == F.col("_symbol")) & F.col("date").between(F.col("entry_date"), F.col("exit_date")))
    run = Window.partitionBy(*keys, *trade, "symbol", "entry_date").orderBy("date")
    start = F.coalesce(F.lag("close").over(run), F.col("entry"))
    stop = F.when(F.col("date") == F.col("exit_date"), F.col("exit")).otherwise(F.col("close"))
    cost = F.when(F.col("date") == F.col("entry_date"), F.lit(buy_rate)).otherwise(0.0) + F.when(
        F.col("date") == F.col("exit_date"), F.lit(sell_rate)
    ).otherwise(0.0)
    daily = held.withColumn("_r", F.col("weight") * (F.coalesce(F.try_divide(stop, start) - 1, F.lit(0.0)) - cost))
    book = daily.groupBy(*keys, "date").agg(F.sum("_r").alias("ret"), F.sum("weight").alias("exposure"))
    grown = F.exp(F.sum(F.log1p("ret")).over(_by(keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return book.withColumn("nav", F.lit(float(capital)) * grown)


def exposure(nav: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return nav.groupBy(*keys).agg(F.avg("exposure").alias("exposure"))


def turnover(trades: DataFrame, nav: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Traded value over twice the average book and the years of it, a year."""
    value = trades.groupBy(*keys).agg(F.sum(2 * F.col("weight")).alias("_traded"))
    years = nav.groupBy(*keys).agg((F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-6))).alias("_years"))
    joined = value.join(years, list(keys)) if keys else value.join(years)
    return joined.select(*keys, (F.col("_traded") / 2 / F.col("_years")).alias("turnover"))


def variants(spark, base: dict, grid: dict[str, Sequence]) -> DataFrame:
    """A row for each combination of overrides: variant, and the parameters of base with the overrides in place."""
    one = spark.createDataFrame([tuple(base.values())], list(base))
    for name, values in grid.items():
        one = one.drop(name).withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    names = list(dict.fromkeys([*base, *grid]))
    label = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in grid])
    return one.select(label.alias("variant"), *names)


def sweep(panel: DataFrame, grid: DataFrame, select, evaluate, metric: str, ascending: bool = False) -> DataFrame:
    """Metrics of every variant from one plan, ranked; variants without a value come last either way.

    select(panel with the variants' parameters on every row) and evaluate(selection) keep the variant key. The variants are a
    small table made by hand; features were computed before, once for all of them. Every row of the panel is taken once for each
    variant; where variants differ in how many they take or in the sector cap only, top_n_variants takes it once.
    """
    crossed = panel.withColumn("_v", F.lit(1)).join(F.broadcast(grid.withColumn("_v", F.lit(1))), "_v").drop("_v")
    return ranked_variants(grid, evaluate(select(crossed)), metric, ascending)


def top_n_variants(panel: DataFrame, grid: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """The selections of all variants: rows of panel (date, symbol, sector, eligible, `by`) with variant and position.

    grid (variant, n, sector_cap) is a small table made by hand. Rows are ranked within date and sector once for all variants, and
    once for each different sector_cap those that it lets through; variants that differ in n read prefixes of one ranking. So the
    panel isn't copied, and only rows that some variant selects are given out once for each of these.
    """
    key = [F.asc(by), F.asc("symbol")] if ascending else [F.desc(by), F.desc("symbol")]
    caps = F.broadcast(grid.groupBy("sector_cap").agg(F.max("n").alias("_most")))
    own = panel.filter(F.col("eligible") & F.col(by).isNotNull())
    own = own.withColumn("_in_sector", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*key)))
    through = own.join(caps, F.col("_in_sector") <= F.col("sector_cap"))
    through = through.withColumn("position", F.row_number().over(Window.partitionBy("sector_cap", "date").orderBy(*key))).filter("position <= _most")
    chosen = through.join(F.broadcast(grid.select("variant", "n", F.col("sector_cap").alias("_cap"))), (F.col("sector_cap") == F.col("_cap")) & (F.col("position") <= F.col("n")))
    return chosen.drop("_in_sector", "_most", "_cap")


def ranked_variants(grid: DataFrame, metrics: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """grid with each variant's metrics and rank; variants without a value come last either way."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return grid.join(metrics, "variant", "left").withColumn("rank", F.row_number().over(Window.orderBy(order, "variant")))  # one row a variant


def wf_windows(spark, start: str, end: str, is_years: int, oos_years: int) -> DataFrame:
    """window, is_start, is_end, oos_start, oos_end: rolled by the out-of-sample length, the last clipped to the end."""
    one = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return windows_between(one, is_years, oos_years).drop("start", "end")


def windows_between(spans: DataFrame, is_years: int, oos_years: int) -> DataFrame:
    """The windows of wf_windows for each row of spans (start, end and other columns)."""
    last = F.add_months("end", -12 * is_years)
    starts = F.when(last > F.col("start"), F.sequence("start", F.date_sub(last, 1), F.expr(f"interval {oos_years} years")))
    rows = spans.select("*", F.posexplode(starts).alias("window", "is_start"))
    oos = F.add_months("is_start", 12 * is_years)
    oos_end = F.least(F.date_sub(F.add_months(oos, 12 * oos_years), 1), "end")
    return rows.select(*spans.columns, "window", "is_start", F.date_sub(oos, 1).alias("is_end"), oos.alias("oos_start"), oos_end.alias("oos_end"))


def walk_forward(nav: DataFrame, windows: DataFrame, metric: str = "cagr") -> DataFrame:
    """A row for each window: the variant best in sample, its metric in and out of sample.

    Every day of a curve goes once into the summary of its block between two edges of windows; windows then merge summaries.
    """
    spans = F.array(
        *[F.struct(F.lit(part).alias("part"), F.col(f"{part}_start").alias("start"), F.col(f"{part}_end").alias("end")) for part in ("is", "oos")]
    )
    asked = windows.select("window", F.inline(spans))
    found = window_summaries(nav, asked, ("window", "part")).select("window", "part", "variant", F.col(metric).alias("m"))
    best = found.filter("part = 'is'").groupBy("window").agg(F.max_by("variant", F.struct("m", "variant")).alias("variant"), F.max("m").alias("in_sample"))
    out = found.filter("part = 'oos'").select("window", "variant", F.col("m").alias("out_of_sample"))
    return best.join(out, ["window", "variant"], "left")


def wf_verdict(result: DataFrame, robust: float = 0.5) -> DataFrame:
    """One row: averages, degradation, ratio and verdict of a walk-forward result."""
    sums = result.filter("out_of_sample is not null").agg(
        F.count("*").alias("n_windows"), F.avg("in_sample").alias("in_sample"), F.avg("out_of_sample").alias("out_of_sample")
    )
    r = F.when(F.col("in_sample") > 0, F.col("out_of_sample") / F.col("in_sample"))
    sums = sums.withColumn("degradation", F.col("in_sample") - F.col("out_of_sample")).withColumn("ratio", r)
    said = F.when(F.col("ratio").isNull(), "inconclusive").when(F.col("ratio") >= robust, "robust").otherwise("likely-curve-fit")
    return sums.withColumn("verdict", said)


def cost_sensitivity(exits: DataFrame, mults: Sequence[float] = (0.0, 1.0, 2.0)) -> DataFrame:
    """Number, mean return and win rate of the trades for each multiple of the costs."""
    crossed = exits.withColumn("cost_mult", F.explode(F.array(*[F.lit(float(m)) for m in mults])))
    paid = F.col("entry") * (1 + F.lit(BUY_RATE) * F.col("cost_mult"))
    got = F.col("exit") * (1 - F.lit(SELL_RATE) * F.col("cost_mult"))
    net = F.when(paid > 0, got / paid - 1)
    return crossed.groupBy("cost_mult").agg(F.count(net).alias("n"), F.avg(net).alias("mean_return"), F.avg((net > 0).cast("double")).alias("win_rate"))


def compare(nav: DataFrame, a: str, b: str) -> DataFrame:
    """date and the two variants' curves side by side."""
    both = nav.filter(F.col("variant").isin(a, b))
    return both.groupBy("date").agg(F.max(F.when(F.col("variant") == a, F.col("nav"))).alias("nav_a"), F.max(F.when(F.col("variant") == b, F.col("nav"))).alias("nav_b"))

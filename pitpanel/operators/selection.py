"""Ranking, selection, weighting and signal lists. Every output is per date; filter to rebalance dates before ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind

BUY_RATE, SELL_RATE, SELL_FLAT = 0.0011862, 0.0010362, 15.93


def pct_rank(col: str, order: str = "desc", by: Sequence[str] = ("date",), within: Column | None = None) -> Column:
    """Rank of a value among the non-null ones of its date, ties averaged, over their number; "asc" ranks small values high.

    within (such as eligibility) limits both the ranked rows and the result.
    """
    value = F.when(within, F.col(col)) if within is not None else F.col(col)
    value = -value if order == "asc" else value
    ranks = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*by, value))
    n = F.count(value).over(Window.partitionBy(*by))
    return F.when(value.isNotNull(), (F.rank().over(ranks) + (ties - 1) / 2) / n)


def blend_rank(df: DataFrame, factors: Sequence[tuple[str, float, str]], eligible: str = "eligible", out: str = "score") -> DataFrame:
    """Weighted mean of the factors' percentiles over those a row has; null for no factor and for rows that aren't eligible."""
    keep = F.col(eligible)
    names = [f"_pct{i}" for i in range(len(factors))]
    df = df.withColumns({n: pct_rank(c, order, within=keep) for n, (c, _, order) in zip(names, factors, strict=True)})
    parts = list(zip(names, [w for _, w, _ in factors], strict=True))
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in parts])
    low = reduce(lambda a, b: a + b, [F.when(F.col(n).isNotNull(), F.lit(float(w))).otherwise(0.0) for n, w in parts])
    return df.withColumn(out, F.when(keep, F.try_divide(top, F.nullif(low, F.lit(0.0))))).drop(*names)


def empty_factors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The factors without a single value."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("n")) for c in cols])).alias("x"))
    return long.select("x.*").filter("n = 0").select("factor")


def rebalance_dates(calendar: DataFrame, freq: str = "weekly") -> DataFrame:
    """First trading date of each period: daily, weekly (from Monday), fortnightly (every second week), monthly, quarterly."""
    dates = calendar.select("date").distinct()
    if freq == "daily":
        return dates
    unit = {"weekly": "week", "fortnightly": "week", "monthly": "month", "quarterly": "quarter"}[freq]
    first = dates.groupBy(F.date_trunc(unit, "date").alias("_period")).agg(F.min("date").alias("date"))
    if freq == "fortnightly":  # one row a week
        first = first.withColumn("_n", F.row_number().over(Window.orderBy("_period"))).filter("_n % 2 = 1")
    return first.select("date")


def select_top_n(df: DataFrame, n: int, sector_cap: int | None = None, order: str = "desc", rank: str = "score") -> DataFrame:
    """The n best rows of each date, at most sector_cap of a sector; ties go by symbol in the same direction; null never counts."""
    key = [F.col(rank).desc(), F.col("symbol").desc()] if order == "desc" else [F.col(rank).asc(), F.col("symbol").asc()]
    df = df.filter(F.col(rank).isNotNull())
    if sector_cap:
        df = df.withColumn("_s", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*key))).filter(F.col("_s") <= sector_cap).drop("_s")
    return df.withColumn("position", F.row_number().over(Window.partitionBy("date").orderBy(*key))).filter(F.col("position") <= n)


def equal_weight(sel: DataFrame, n: int, invest_fully: bool = False) -> DataFrame:
    chosen = F.count("*").over(Window.partitionBy("date"))
    return sel.withColumn("weight", 1 / chosen if invest_fully else F.lit(1.0 / n))


def inverse_vol_weight(sel: DataFrame, vol: str = "ret_vol") -> DataFrame:
    """Weights in proportion to 1 / volatility; null or non-positive volatility weighs 0."""
    inverse = F.when(F.col(vol) > 0, 1 / F.col(vol)).otherwise(0.0)
    total = F.sum(inverse).over(Window.partitionBy("date"))
    return sel.withColumn("weight", inverse / F.when(total > 0, total).otherwise(1.0))


def cap_weights(sel: DataFrame, cap: float) -> DataFrame:
    """No weight above cap; what is cut off goes to the others in equal parts, as far as they have room; the rest stays cash.

    In descending order the k largest end at the cap and the others rise by one amount t_k; the smallest k where the next
    weight then stays within the cap is the answer, so no iteration is needed.
    """
    w = Window.partitionBy("date").orderBy(F.col("weight").desc(), "symbol")
    whole = Window.partitionBy("date")
    rest = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    k = F.row_number().over(w) - 1
    n = F.count("*").over(whole)
    df = sel.withColumns({"_k": k, "_n": n, "_rest": rest, "_total": F.sum("weight").over(whole)})
    lift = (F.col("_total") - F.col("_k") * cap - F.col("_rest")) / (F.col("_n") - F.col("_k"))
    df = df.withColumn("_t", lift)
    df = df.withColumn("_ok", F.when(F.col("weight") + F.col("_t") <= cap + 1e-12, F.struct("_k", "_t")))
    df = df.withColumn("_best", F.min("_ok").over(whole))
    full = F.col("_total") >= F.col("_n") * cap - 1e-12
    lifted = F.least(F.lit(cap), F.col("weight") + F.coalesce(F.col("_best._t"), F.lit(0.0)))
    return df.withColumn("weight", F.when(full, F.lit(cap)).otherwise(lifted)).drop("_k", "_n", "_rest", "_total", "_t", "_ok", "_best")


def regime(bench: DataFrame, ma: int = 200) -> DataFrame:
    """date, close, ma and on (null while the mean isn't ready) of a benchmark series of one row a date."""
    w = Window.orderBy("date")  # one series, a few thousand rows
    mean = ind.rolling(F.avg, F.col("close"), ma, w=w)
    return bench.select("date", "close", mean.alias("ma")).withColumn("on", F.col("close") >= F.col("ma"))


def apply_regime(sel: DataFrame, reg: DataFrame, mode: str = "scale", below: float = 0.0) -> DataFrame:
    """Weights times `below` on dates when the benchmark is under its mean; an unready mean counts as over.

    With mode "binary" and below <= 0 such dates have no selection.
    """
    joined = sel.join(F.broadcast(reg.select("date", F.col("on").alias("_on"))), "date", "left")
    off = F.coalesce(~F.col("_on"), F.lit(False))
    if mode == "binary" and below <= 0:
        return joined.filter(~off).drop("_on")
    return joined.withColumn("weight", F.when(off, F.col("weight") * below).otherwise(F.col("weight"))).drop("_on")


def regime_state(bench: DataFrame, ma: int = 200, below: float = 0.0) -> DataFrame:
    """One row: the latest date, close, mean, on (an unready mean counts as off) and exposure."""
    last = regime(bench, ma).agg(F.max_by(F.struct("date", "close", "ma", F.coalesce("on", F.lit(False)).alias("on")), "date").alias("x"))
    return last.select("x.*").withColumn("exposure", F.when(F.col("on"), F.lit(1.0)).otherwise(F.lit(float(below))))


def size_orders(sel: DataFrame, capital: float, adtv_share: float = 0.1, buy_rate: float = BUY_RATE) -> DataFrame:
    """notional = weight * capital, at most adtv_share of the average traded value where that is known; whole shares of it."""
    wanted = F.col("weight") * capital
    notional = F.when(F.col("adtv") > 0, F.least(wanted, F.col("adtv") * adtv_share)).otherwise(wanted)
    shares = F.floor(F.try_divide(notional, F.col("price") * (1 + buy_rate)))
    return sel.withColumn("notional", notional).withColumn("shares", F.greatest(shares, F.lit(0)))


def stop_target(
    df: DataFrame, stop: tuple[str, float] | None = ("pct", 0.1), target: tuple[str, float] | None = ("r", 2.0), price: str = "price", atr: str = "atr"
) -> DataFrame:
    """Adds stop, target, risk. stop: ("pct", share) or ("atr" or "trailing", multiple); target: ("pct", share) or ("r", multiple of risk)."""
    p = F.col(price)
    none = F.lit(None).cast("double")
    level = none if not stop else p * (1 - stop[1]) if stop[0] == "pct" else p - F.col(atr) * stop[1]
    df = df.withColumn("stop", level).withColumn("risk", p - F.col("stop"))
    if not target:
        goal = none
    else:
        goal = p * (1 + target[1]) if target[0] == "pct" else F.when(F.col("risk") > 0, p + F.col("risk") * target[1])
    return df.withColumn("target", goal)


def next_fill(sel: DataFrame, bars: DataFrame, mode: str = "open") -> DataFrame:
    """Adds fill_date and fill_price: the open of the next calendar date ("open"), or the same date's close ("close")."""
    if mode == "close":
        same = bars.select("symbol", "date", F.col("close").alias("fill_price"))
        return sel.join(same, ["symbol", "date"]).withColumn("fill_date", F.col("date"))
    days = bars.select("date").distinct().withColumn("fill_date", F.lead("date").over(Window.orderBy("date")))  # one row a date
    opens = bars.select("symbol", F.col("date").alias("fill_date"), F.col("open").alias("fill_price"))
    return sel.join(F.broadcast(days), "date").join(opens, ["symbol", "fill_date"])


def signal_diff(today: DataFrame, before: DataFrame) -> DataFrame:
    """symbol and action: buy (new), hold (still there) or sell (gone), with today's levels rounded."""
    old = before.select("symbol", F.lit(True).alias("_old"))
    joined = today.withColumn("_new", F.lit(True)).join(old, "symbol", "full")
    action = F.when(F.col("_new").isNull(), "sell").when(F.col("_old").isNull(), "buy").otherwise("hold")
    levels = [c for c in ("price", "stop", "target", "weight") if c in today.columns]
    return joined.select("symbol", action.alias("action"), *[F.round(c, 4 if c == "weight" else 2).alias(c) for c in levels])


def with_entry_context(signals: DataFrame, bars: DataFrame, ma: int = 50, rsi_n: int = 14) -> DataFrame:
    """Adds the extension over the moving average in percent and the RSI at each symbol's latest bar."""
    context = ind.rsi(bars.withColumn("_ma", ind.sma(F.col("close"), ma)), rsi_n, out="rsi")
    context = context.withColumn("extension", (F.try_divide("close", "_ma") - 1) * 100)
    last = context.groupBy("symbol").agg(F.max_by(F.struct("extension", "rsi"), "date").alias("x")).select("symbol", "x.*")
    return signals.join(last, "symbol", "left")


def freshness(bars: DataFrame, today, max_age: int = 3, least_bars: int = 60) -> DataFrame:
    """symbol, last_date, age in days, n_bars and the two warnings stale and short_history."""
    per = bars.groupBy("symbol").agg(F.max("date").alias("last_date"), F.count("close").alias("n_bars"))
    age = F.datediff(F.lit(today).cast("date"), "last_date")
    return per.select("symbol", "last_date", age.alias("age"), "n_bars", (age > max_age).alias("stale"), (F.col("n_bars") < least_bars).alias("short_history"))


def annotate(signals: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds surveillance ("LIST stage; ...") and warn, for flagged names that are bought or held."""
    text = F.array_join(F.transform("flags", lambda f: F.concat_ws(" ", f["list_type"], f["stage"])), "; ")
    joined = signals.join(flags.select("symbol", text.alias("surveillance")), "symbol", "left")
    return joined.withColumn("warn", F.col("surveillance").isNotNull() & F.col("action").isin("buy", "hold"))


def order_sheet(signals: DataFrame, capital: float, n: int, buy_rate: float = BUY_RATE, sell_rate: float = SELL_RATE, flat: float = SELL_FLAT) -> DataFrame:
    """One row: buys, sells, turnover of buys in whole shares, and estimated cost."""
    qty = F.floor(F.try_divide(F.lit(capital) * F.col("weight"), F.col("price")))
    buys = F.when(F.col("action") == "buy", qty * F.col("price"))
    sums = signals.agg(
        F.count_if(F.col("action") == "buy").alias("buys"), F.count_if(F.col("action") == "sell").alias("sells"), F.coalesce(F.sum(buys), F.lit(0.0)).alias("turnover")
    )
    cost = F.col("turnover") * buy_rate + F.col("sells") * (capital / n) * sell_rate + F.col("sells") * flat
    return sums.withColumn("cost", cost)


def next_rebalance(day: Column, freq: str) -> Column:
    return {
        "daily": lambda: F.date_add(day, 1),
        "weekly": lambda: F.next_day(day, "Mon"),
        "fortnightly": lambda: F.date_add(day, 14),
        "monthly": lambda: F.to_date(F.add_months(F.trunc(day, "month"), 1)),
        "quarterly": lambda: F.to_date(F.add_months(F.trunc(day, "quarter"), 3)),
    }[freq]()

"""Performance of equity curves and trades, grouped by any variant keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
_V = ("variant",)


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def _so_far(keys: Sequence[str]):
    return _series(keys).rowsBetween(Window.unboundedPreceding, 0)


def returns_summary(nav: DataFrame, keys: Sequence[str] = _V) -> DataFrame:
    """total_return, cagr, volatility, sharpe, sortino, max_drawdown of curves (keys, date, nav); 0 for under two points."""
    r = F.try_divide("nav", F.lag("nav").over(_series(keys))) - 1
    dd = F.try_divide(F.col("nav"), F.max("nav").over(_so_far(keys))) - 1
    agg = nav.withColumn("_r", r).withColumn("_dd", dd).groupBy(*keys).agg(
        F.count("nav").alias("n"),
        (F.try_divide(F.max_by("nav", "date"), F.min_by("nav", "date"))).alias("_growth"),
        F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-6)).alias("_years"),
        F.avg("_r").alias("_mean"),
        F.stddev_samp("_r").alias("_std"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_down"),
        F.min("_dd").alias("_max_dd"),
    )
    return _summary(agg, keys)


def _summary(agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    year = TRADING_DAYS**0.5
    two = F.col("n") >= 2
    zero = lambda c: F.coalesce(F.when(two, c), F.lit(0.0))
    over = lambda std: F.when(F.col(std) > 0, F.col("_mean") / F.col(std) * year)
    return agg.select(
        *keys,
        zero(F.col("_growth") - 1).alias("total_return"),
        zero(F.pow("_growth", 1 / F.col("_years")) - 1).alias("cagr"),
        zero(F.col("_std") * year).alias("volatility"),
        zero(over("_std")).alias("sharpe"),
        zero(over("_down")).alias("sortino"),
        zero(F.col("_max_dd")).alias("max_drawdown"),
    )


def block_summaries(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a stretch of a curve (keys, date, nav above 0) leaves behind, so that stretches that follow each other can be merged.

    First and last day with their values, count, sums of the returns inside, extremes, and the worst drawdown inside.
    """
    r = F.try_divide("nav", F.lag("nav").over(_series(keys))) - 1
    dd = F.try_divide(F.col("nav"), F.max("nav").over(_so_far(keys))) - 1
    down = F.when(F.col("_r") < 0, F.col("_r"))
    return nav.withColumn("_r", r).withColumn("_dd", dd).groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min_by("nav", "date").alias("first_nav"), F.max_by("nav", "date").alias("last_nav"),
        F.count("nav").alias("n"), F.min("nav").alias("low"), F.max("nav").alias("high"), F.min("_dd").alias("worst"),
        F.count("_r").alias("r_n"), F.avg("_r").alias("r_mean"), F.var_pop("_r").alias("r_var"),
        F.count(down).alias("d_n"), F.avg(down).alias("d_mean"), F.var_pop(down).alias("d_var"),
    )


def merged_summaries(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of returns_summary for curves that are the blocks of block_summaries of each key in order of date."""
    before = _series_of(keys)
    link = F.try_divide(F.col("first_nav"), F.lag("last_nav").over(before)) - 1  # the return from block to block
    peak = F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1))
    linked = blocks.withColumn("_link", link).withColumn("_dd", F.least("worst", F.try_divide(F.col("low"), peak) - 1))
    parts = F.array(
        F.struct(F.col("r_n").alias("n"), F.col("r_mean").alias("mean"), F.col("r_var").alias("var")),
        F.struct(F.col("_link").isNotNull().cast("long").alias("n"), F.col("_link").alias("mean"), F.lit(0.0).alias("var")),
    )
    falls = F.array(
        F.struct(F.col("d_n").alias("n"), F.col("d_mean").alias("mean"), F.col("d_var").alias("var")),
        F.struct((F.col("_link") < 0).cast("long").alias("n"), F.when(F.col("_link") < 0, F.col("_link")).alias("mean"), F.lit(0.0).alias("var")),
    )
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["n"] * f(x), F.lit(0.0)))
    sums = linked.select(
        *keys, "first_date", "last_date", "first_nav", "last_nav", "n", "_dd",
        *[c for name, items in (("r", parts), ("d", falls)) for c in (
            total(items, lambda x: F.lit(1.0)).alias(f"{name}_n"), total(items, lambda x: x["mean"]).alias(f"{name}_sum"),
            total(items, lambda x: x["var"] + x["mean"] * x["mean"]).alias(f"{name}_squares"),
        )],
    )
    agg = sums.groupBy(*keys).agg(
        F.min("first_date").alias("_a"), F.max("last_date").alias("_z"), F.min_by("first_nav", "first_date").alias("_first"), F.max_by("last_nav", "last_date").alias("_last"),
        F.sum("n").alias("n"), F.min("_dd").alias("_max_dd"), *[F.sum(f"{x}_{y}").alias(f"{x}_{y}") for x in "rd" for y in ("n", "sum", "squares")],
    )
    spread = lambda x: F.when(F.col(f"{x}_n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col(f"{x}_squares") - F.col(f"{x}_sum") * F.col(f"{x}_sum") / F.col(f"{x}_n")) / (F.col(f"{x}_n") - 1)))
    years = F.greatest(F.datediff("_z", "_a") / 365.25, F.lit(1e-6))
    ready = agg.select(*keys, "n", F.try_divide("_last", "_first").alias("_growth"), years.alias("_years"), F.try_divide("r_sum", "r_n").alias("_mean"), spread("r").alias("_std"), spread("d").alias("_down"), "_max_dd")
    return _summary(ready, keys)


def _series_of(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("first_date")


def window_summaries(nav: DataFrame, windows: DataFrame, names: Sequence[str], keys: Sequence[str] = _V) -> DataFrame:
    """names, keys and the columns of returns_summary of every curve in every window (names, start, end, both days included).

    windows is a small table; what they have to do with each other doesn't matter. The edges of all of them cut each curve into blocks, every
    day is summarised once with its block, and each window merges the blocks that it holds.
    """
    edges = windows.select(F.explode(F.array("start", F.date_add("end", 1))).alias("edge")).agg(F.array_sort(F.collect_set("edge")).alias("_edges"))
    block = F.size(F.filter("_edges", lambda e: e <= F.col("date")))
    blocks = block_summaries(nav.join(F.broadcast(edges)).withColumn("_block", block).drop("_edges"), [*keys, "_block"])
    spans = F.broadcast(windows.select(*names, F.col("start").alias("_start"), F.col("end").alias("_end")))
    held = blocks.join(spans, (F.col("first_date") >= F.col("_start")) & (F.col("last_date") <= F.col("_end"))).drop("_start", "_end", "_block")
    return merged_summaries(held, [*names, *keys])


def drawdown(nav: DataFrame, keys: Sequence[str] = _V) -> DataFrame:
    return nav.withColumn("drawdown", F.col("nav") / F.max("nav").over(_so_far(keys)) - 1)


def max_drawdown(nav: DataFrame, keys: Sequence[str] = _V) -> DataFrame:
    """keys, max_drawdown, peak_date (first date of the peak), trough_date (first date of the minimum)."""
    peak = F.max(F.struct(F.col("nav").alias("v"), (-F.unix_date("date")).alias("d"))).over(_so_far(keys))
    marked = nav.withColumn("_p", peak).withColumn("_dd", F.col("nav") / F.col("_p.v") - 1)
    worst = marked.groupBy(*keys).agg(F.min_by(F.struct("_dd", "date", "_p"), F.struct("_dd", "date")).alias("x"))
    return worst.select(
        *keys, F.col("x._dd").alias("max_drawdown"), F.date_from_unix_date(-F.col("x._p.d").cast("int")).alias("peak_date"), F.col("x.date").alias("trough_date")
    )


def monthly_returns(nav: DataFrame, keys: Sequence[str] = _V) -> DataFrame:
    month = F.to_date(F.date_trunc("month", "date"))
    last = nav.groupBy(*keys, month.alias("month")).agg(F.max_by("nav", "date").alias("nav"))
    r = F.try_divide("nav", F.lag("nav").over(Window.partitionBy(*keys).orderBy("month"))) - 1
    return last.withColumn("ret", r).filter("ret is not null").select(*keys, "month", "ret")


def trade_stats(trades: DataFrame, keys: Sequence[str] = _V) -> DataFrame:
    """n, win_rate, avg_win, avg_loss, profit_factor (0 without losses), avg_holding_days."""
    r = F.col("return_pct")
    won, lost = F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, r))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.when(lost < 0, won / -lost), F.lit(0.0)).alias("profit_factor"),
        F.coalesce(F.avg("holding_days"), F.lit(0.0)).alias("avg_holding_days"),
    )


def vs_benchmark(summary: DataFrame, bench: DataFrame, stats: DataFrame, keys: Sequence[str] = _V, least_exposure: float = 0.01) -> DataFrame:
    """summary with benchmark_cagr, active_return and note; both null without trades or with hardly any exposure.

    bench (date, nav) is one series; stats has n (trades) and exposure by key.
    """
    one = returns_summary(bench.withColumn("variant", F.lit("bench"))).select(F.col("cagr").alias("_b"))
    joined = summary.join(stats.select(*keys, F.col("n").alias("_n"), F.col("exposure").alias("_e")), list(keys), "left").join(F.broadcast(one))
    idle = (F.coalesce("_n", F.lit(0)) == 0) | (F.coalesce("_e", F.lit(0.0)) < least_exposure)
    return joined.select(
        *summary.columns,
        F.when(~idle, F.col("_b")).alias("benchmark_cagr"),
        F.when(~idle, F.col("cagr") - F.col("_b")).alias("active_return"),
        F.when(idle, F.lit("no meaningful exposure")).alias("note"),
    )


def rebase(bench: DataFrame, capital: float, keys: Sequence[str] = ()) -> DataFrame:
    """A curve that starts at the capital."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bench.withColumn("nav", F.lit(float(capital)) * F.try_divide(F.col("close"), F.first("close", ignorenulls=True).over(w)))

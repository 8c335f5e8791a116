"""Corporate actions, delistings and market capitalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import by_symbol
from .pit import asof_join

#: Ratios that splits and bonus issues come in (fixed values).
CANONICAL = (1.25, 1.33, 1.5, 1.67, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 10.0, 11.0)


def gap_candidates(bars: DataFrame, high: float = 1.18, low: float = 0.84) -> DataFrame:
    """symbol, date, ratio of overnight gaps: close before / close beyond the bounds."""
    before = F.lag("close").over(by_symbol())
    gaps = bars.filter("close > 0").withColumn("ratio", F.try_divide(before, F.col("close")))
    return gaps.filter((F.col("ratio") > high) | (F.col("ratio") < low)).select("symbol", "date", "ratio")


def snap_ratio(g: Column, tolerance: float, canonical: Sequence[float] = CANONICAL) -> Column:
    """The nearest canonical ratio within a relative error, else null. Below 1 the inverse is snapped and turned back."""
    size = F.when(g < 1, F.try_divide(F.lit(1.0), g)).otherwise(g)
    steps = F.array(*[F.lit(float(c)) for c in canonical])
    nearest = F.array_min(F.transform(steps, lambda c: F.struct((F.abs(size - c) / c).alias("e"), c.alias("c"))))
    return F.when(nearest["e"] < tolerance, F.when(g < 1, 1 / nearest["c"]).otherwise(nearest["c"]))


def share_steps(shares: DataFrame, up: float = 1.4, down: float = 0.72, tolerance: float = 0.10) -> DataFrame:
    """symbol, date, step of share counts (symbol, date, shares) that change by a canonical ratio."""
    f = F.try_divide(F.col("shares"), F.lag("shares").over(by_symbol()))
    steps = shares.filter("shares > 0").withColumn("_f", f).filter((F.col("_f") > up) | (F.col("_f") < down))
    return steps.withColumn("step", snap_ratio(F.col("_f"), tolerance)).filter("step is not null").select("symbol", "date", "step")


def share_proxies(eav: DataFrame, hist: DataFrame) -> DataFrame:
    """symbol, date, shares, source: net profit / EPS, equity / book value per share, owner profit / EPS."""
    from .fundamentals import eav_pivot

    wide = eav_pivot(eav, ["NP", "EPS", "EQUITY", "BVPS"])
    proxy = lambda total, per, source: F.struct(
        "id", "date", F.when(F.col(per) > 0, F.try_divide(total, per)).alias("shares"), F.lit(source).alias("source")
    )
    both = wide.select(F.inline(F.array(proxy("NP", "EPS", "np_eps"), proxy("EQUITY", "BVPS", "equity_bvps"))))  # one pivot for both
    owner = hist.filter("eps > 0").select(
        "id", F.col("period_end").alias("date"), F.try_divide("net_profit_owner", "eps").alias("shares"), F.lit("owner_eps").alias("source")
    )
    out = both.unionByName(owner)
    return out.filter("shares > 0").withColumnRenamed("id", "symbol")


def confirm_actions(candidates: DataFrame, steps: DataFrame, days: int = 380, tolerance: float = 0.08) -> DataFrame:
    """symbol, ex_date, ratio, step_date: gaps with a share step of about their ratio within `days`; the nearest step counts.

    Of two steps as near the earlier one counts. A symbol's steps have few sizes, those of splits and bonus issues: a gap takes the sizes that are
    about its ratio, and along a sort by symbol, size and date meets the last step before it and the first one after it, not all
    that lie within the days.
    """
    c = candidates.select("symbol", F.col("date").alias("ex_date"), snap_ratio(F.col("ratio"), tolerance).alias("ratio")).dropna()
    s = steps.select("symbol", "step", F.col("date").alias("step_date")).dropna().distinct()
    sizes = s.select("symbol", "step").distinct()
    asked = c.join(sizes, "symbol").filter(F.abs(F.col("step") / F.col("ratio") - 1) <= tolerance)
    both = asked.withColumn("_at", F.col("ex_date")).unionByName(s.withColumn("_at", F.col("step_date")), allowMissingColumns=True)
    key = Window.partitionBy("symbol", "step")
    found = both.withColumns({  # steps come first on their own day in either order
        "_before": F.last("step_date", ignorenulls=True).over(key.orderBy("_at", F.col("step_date").isNull()).rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.last("step_date", ignorenulls=True).over(key.orderBy(F.desc("_at"), F.col("step_date").isNull()).rowsBetween(Window.unboundedPreceding, 0)),
    })
    found = found.filter("ex_date is not null").select("symbol", "ex_date", "ratio", F.explode(F.array("_before", "_after")).alias("step_date"))
    apart = F.abs(F.datediff("step_date", "ex_date"))
    nearest = F.struct(apart, "step_date")
    return found.filter(apart <= days).groupBy("symbol", "ex_date").agg(F.min_by("ratio", nearest).alias("ratio"), F.min_by("step_date", nearest).alias("step_date"))


def adjustment_factors(events: DataFrame, first_dates: DataFrame) -> DataFrame:
    """symbol, from_date, factor: what prices from a date on are multiplied with; the latest segment has exactly 1.

    events (symbol, ex_date, ratio); first_dates (symbol, first_date) starts the segment before the first event.
    """
    w = Window.partitionBy("symbol").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol")
    ratios = events.withColumn("_r", F.product("ratio").over(w)).withColumn("_all", F.product("ratio").over(whole))
    later = ratios.select("symbol", F.col("ex_date").alias("from_date"), (F.col("_r") / F.col("_all")).alias("factor"))
    start = ratios.groupBy("symbol").agg(F.max("_all").alias("_all")).join(first_dates, "symbol")
    return later.unionByName(start.select("symbol", F.col("first_date").alias("from_date"), (1 / F.col("_all")).alias("factor")))


def delistings(
    bars: DataFrame, dead: DataFrame, events: DataFrame, candidates: DataFrame, mcap: DataFrame, large: float = 0.35
) -> DataFrame:
    """symbol, last_date, last_close, peak_mcap and ca_uncertain (a large gap and no confirmed event) of dead symbols."""
    ended = bars.join(dead.select("symbol").distinct(), "symbol", "left_semi").filter("close is not null")
    last = ended.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
    peak = mcap.groupBy("symbol").agg(F.max("mcap").alias("peak_mcap"))
    big = candidates.filter((F.col("ratio") > 1 + large) | (F.col("ratio") < 1 / (1 + large))).select("symbol").distinct()
    unsure = big.join(events.select("symbol").distinct(), "symbol", "left_anti").withColumn("_unsure", F.lit(True))
    joined = last.join(peak, "symbol", "left").join(unsure, "symbol", "left")
    return joined.select("symbol", "last_date", "last_close", "peak_mcap", F.coalesce("_unsure", F.lit(False)).alias("ca_uncertain"))


def match_events(predicted: DataFrame, truth: DataFrame, days: int = 3, tolerance: float = 0.10) -> DataFrame:
    """One row: tp, fp, fn, precision, recall of events (symbol, date, ratio), matched one to one.

    Pairs in reach are taken by nearness, then by the dates, whenever neither side is taken yet. Pairs as far apart as each other
    make chains in which each can only compete with the one before and the one after it, so in order of dates every other one of
    a chain is taken: a sweep for each distance that holds no more than the pair before, however dense the events.
    """
    taken = _pairs(predicted, truth, days, tolerance)
    for distance in range(1, days + 1):
        taken = _swept(taken, distance)
    tp = taken.agg(F.count_if(F.col("taken")).alias("tp"))
    counts = tp.join(predicted.agg(F.count("*").alias("_np"))).join(truth.agg(F.count("*").alias("_nt")))
    return counts.select(
        "tp",
        (F.col("_np") - F.col("tp")).alias("fp"),
        (F.col("_nt") - F.col("tp")).alias("fn"),
        F.try_divide("tp", "_np").alias("precision"),
        F.try_divide("tp", "_nt").alias("recall"),
    )


def _pairs(predicted: DataFrame, truth: DataFrame, days: int, tolerance: float) -> DataFrame:
    """symbol, p and t (dates as numbers), and taken of the pairs in reach; those on the same day are taken. Each event looks up the days around its own."""
    p = predicted.select("symbol", F.unix_date("date").alias("p"), "ratio", F.explode(F.array(*[F.lit(k) for k in range(-days, days + 1)])).alias("_off"))
    t = truth.select("symbol", F.unix_date("date").alias("t"), F.col("ratio").alias("_ratio"))
    near = p.withColumn("t", F.col("p") + F.col("_off")).join(t, ["symbol", "t"]).filter(F.abs(F.col("ratio") / F.col("_ratio") - 1) <= tolerance)
    return near.select("symbol", "p", "t", (F.col("p") == F.col("t")).alias("taken")).distinct()


def _swept(pairs: DataFrame, distance: int) -> DataFrame:
    """pairs with those of one distance taken, as far as neither side is taken yet, every other one of each chain."""
    side = lambda c: F.max("taken").over(Window.partitionBy("symbol", c))
    held = pairs.withColumn("_p", side("p")).withColumn("_t", side("t"))
    free = (F.abs(F.col("p") - F.col("t")) == distance) & ~F.col("_p") & ~F.col("_t")
    chain = Window.partitionBy("symbol", "_free", F.pmod("p", F.lit(2 * distance))).orderBy("p", "t")
    linked = (F.lag("p").over(chain) == F.col("p")) | (F.lag("t").over(chain) == F.col("t"))
    marked = held.withColumn("_free", free).withColumn("_starts", (~F.coalesce(linked, F.lit(False))).cast("int"))
    marked = marked.withColumn("_nth", F.row_number().over(chain))
    first = F.max(F.when(F.col("_starts") == 1, F.col("_nth"))).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    odd = (F.col("_nth") - first) % 2 == 0
    return marked.select("symbol", "p", "t", (F.col("taken") | (F.col("_free") & odd)).alias("taken"))


def shares_history(quarterly: DataFrame, annual: DataFrame, digits: int | None = None) -> DataFrame:
    """Distinct symbol, date, shares from net profit / EPS of two EAV tables; only positive counts.

    digits rounds the values first: sums that differ only by the order they were added in then give one row, not two.
    """
    from .fundamentals import eav_pivot

    value = F.round("value", digits) if digits is not None else F.col("value")
    both = [eav_pivot(x.withColumn("value", value), ["NP", "EPS"]).select("id", "date", F.try_divide("NP", "EPS").alias("shares")) for x in (quarterly, annual)]
    return both[0].union(both[1]).filter("shares > 0").distinct().withColumnRenamed("id", "symbol")


def pit_mcap_asof(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """symbol, date, mcap: raw close times the share count known at the date; dates before any count are left out."""
    known = shares.select("symbol", F.col("date").alias("_from"), "shares")
    joined = asof_join(prices.select("symbol", "date", "close"), known, "symbol", "date", "_from", how="inner")
    return joined.select("symbol", "date", (F.col("close") * F.col("shares")).alias("mcap"))


def pit_mcap(adjusted: DataFrame, shares: DataFrame) -> DataFrame:
    """symbol, date, mcap: adjusted close times the latest share count of all time, which adjusted prices go with."""
    now = shares.groupBy("symbol").agg(F.max_by("shares", "date").alias("shares"))
    return adjusted.join(now, "symbol").select("symbol", "date", (F.col("close") * F.col("shares")).alias("mcap"))


def membership(live: DataFrame, dead: DataFrame) -> DataFrame:
    """symbol, date, mcap, source of live and ended names."""
    return live.select("symbol", "date", "mcap", F.lit("live").alias("source")).unionByName(
        dead.select("symbol", "date", "mcap", F.lit("dead").alias("source"))
    )


def classify_ended(bars: DataFrame, live: DataFrame, cutoff, peak_value: float = 5e8) -> DataFrame:
    """symbol, isin, last_date, status, renamed_to of symbols that stopped before the cutoff and aren't live.

    Their security id still trading under another symbol makes them renamed, to its latest symbol; otherwise they are dead.
    """
    spans = bars.groupBy("symbol", "isin").agg(
        F.max("date").alias("last_date"), F.max(F.col("close") * F.col("volume")).alias("_peak")
    )
    current = spans.groupBy("isin").agg(F.max_by("symbol", F.struct("last_date", "symbol")).alias("_now"), F.max("last_date").alias("_alive"))
    stop = F.lit(cutoff).cast("date")
    ended = spans.filter((F.col("last_date") < stop) & (F.col("_peak") > peak_value))
    ended = ended.join(live.select("symbol").distinct(), "symbol", "left_anti").join(current, "isin")
    renamed = (F.col("_alive") >= stop) & (F.col("_now") != F.col("symbol"))
    return ended.select(
        "symbol",
        "isin",
        "last_date",
        F.when(renamed, F.lit("renamed")).otherwise(F.lit("dead")).alias("status"),
        F.when(renamed, F.col("_now")).alias("renamed_to"),
    )


def monthly_last(df: DataFrame, value: str = "mcap") -> DataFrame:
    month = F.to_date(F.date_trunc("month", "date"))
    return df.filter(F.col(value).isNotNull()).groupBy("symbol", month.alias("month")).agg(F.max_by(value, "date").alias(value))


def max_step(df: DataFrame, value: str = "mcap") -> DataFrame:
    """symbol and the largest month-over-month step, up or down, of month-end values."""
    r = F.try_divide(F.col(value), F.lag(value).over(Window.partitionBy("symbol").orderBy("month")))
    steps = monthly_last(df, value).withColumn("_r", r).filter("_r > 0")
    return steps.groupBy("symbol").agg(F.max(F.greatest(F.col("_r"), 1 / F.col("_r"))).alias("max_step"))


def membership_counts(members: DataFrame, dates: DataFrame, floor: float, days: int = 14) -> DataFrame:
    """For each asked date and source, the symbols whose last mcap in the `days` before is above the floor."""
    asked = F.broadcast(dates.select(F.col("date").alias("asof")).distinct())  # the dates are given by hand
    recent = members.join(asked, (F.col("date") <= F.col("asof")) & (F.col("date") >= F.date_sub("asof", days)))
    last = recent.groupBy("asof", "source", "symbol").agg(F.max_by("mcap", "date").alias("mcap")).filter(F.col("mcap") > floor)
    return last.groupBy("asof", "source").agg(F.count("*").alias("n"))

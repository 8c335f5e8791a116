"""Building panels: adjustment, calendars, filling, keys, screens and the feature catalogue."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.columns import canon_symbol, finite

PRICES = ("open", "high", "low")


def adjust_ohlc(bars: DataFrame) -> DataFrame:
    """Prices times adj_close / close (1 where that is undefined); close becomes adj_close, or stays where that is null."""
    factor = F.coalesce(finite(F.try_divide("adj_close", "close")), F.lit(1.0))
    return bars.withColumns({c: F.col(c) * factor for c in PRICES} | {"close": F.coalesce("adj_close", "close")})


def bars_between(bars: DataFrame, symbols: DataFrame | Sequence | None = None, start=None, end=None) -> DataFrame:
    """Rows of these symbols with start <= date <= end."""
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    if symbols is None:
        return bars
    if isinstance(symbols, DataFrame):
        return bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return bars.filter(F.col("symbol").isin(list(symbols)))


def to_wide(df: DataFrame, field: str, symbols: Sequence, agg: str = "first") -> DataFrame:
    """One row a date and one column a symbol; "avg" averages repeated keys."""
    fn = {"first": F.first, "avg": F.avg}[agg]
    return df.groupBy("date").pivot("symbol", list(symbols)).agg(fn(field))


def densify(df: DataFrame, calendar: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Every symbol on every date of the calendar (all dates of df); bounded: only between its first and last date.

    The calendar is one row a date, so it is small beside the panel. It is carried to the symbols as one sorted array.
    """
    dates = (calendar or df).select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_days"))
    spans = df.groupBy("symbol").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    grid = spans.join(F.broadcast(dates), how="full").select("symbol", "_first", "_last", F.explode("_days").alias("date"))
    if bounded:
        grid = grid.filter("date between _first and _last")
    return grid.select("symbol", "date").filter("symbol is not null").join(df, ["symbol", "date"], "left")


def ffill(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Last value carried forward over null, for at most `limit` rows if given."""
    w = ind.by_symbol().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def combine_first(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Cells of a, or of b where a has none."""
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    joined = a.select(*keys, *cols).join(right, list(keys), "full")
    return joined.select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def symbol_map(stocks: DataFrame, recovered: DataFrame) -> DataFrame:
    """Distinct (symbol, id) of two lookup tables, symbols in their one form."""
    both = stocks.select("symbol", "id").union(recovered.select("symbol", "id"))
    return both.select(canon_symbol(F.col("symbol").cast("string")).alias("symbol"), "id").dropna().distinct()


def with_sector(df: DataFrame, sectors: DataFrame, default: str = "Unknown") -> DataFrame:
    """sectors (symbol, sector) is a lookup table of one row a symbol; Spark picks the join by its size."""
    one = sectors.groupBy("symbol").agg(F.min("sector").alias("sector"))
    return df.join(one, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def metric_panel(eav: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """date, symbol and the mean value of one metric; symbols maps symbol to id."""
    return eav.filter(F.col("metric") == key).join(symbols, "id").groupBy("date", "symbol").agg(F.avg("value").alias("value"))


def splice_latest(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, and the rows of secondary after the last date that primary has for any symbol."""
    cut = primary.agg(F.max("date").alias("_cut"))
    newer = secondary.join(F.broadcast(cut)).filter("_cut is null or date > _cut").drop("_cut")
    return primary.unionByName(newer)


def adjusted_panel(live: DataFrame, raw: DataFrame, factor: DataFrame, delistings: DataFrame) -> DataFrame:
    """Adjusted bars of live symbols and, for delisted ones, raw bars times the factor at or before their date (1 without any)."""
    from .pit import asof_join

    ended = delistings.select("symbol").distinct()
    dead = asof_join(raw.join(ended, "symbol", "left_semi"), factor, "symbol", "date", "from_date", defaults={"factor": 1.0})
    prices = ("open", "high", "low", "close")
    dead = dead.select("symbol", "date", *[(F.col(c) * F.col("factor")).alias(c) for c in prices])
    return live.join(ended, "symbol", "left_anti").select("symbol", "date", *prices).unionByName(dead)


def traded_value(raw: DataFrame, series: str = "EQ") -> DataFrame:
    return raw.filter((F.col("series") == series) & (F.col("turnover") > 0)).select("symbol", "date", F.col("turnover").alias("traded"))


def benchmark_series(index: DataFrame, name: str, bars: DataFrame) -> DataFrame:
    """date and close of a named index; dates without it, or all if there is no such index, take the mean close of all bars."""
    named = index.filter(F.col("name") == name).groupBy("date").agg(F.max("close").alias("_named"))
    mean = bars.groupBy("date").agg(F.avg("close").alias("_mean"))
    any_named = named.agg((F.count("*") > 0).alias("_some"))
    joined = mean.join(named, "date", "left").join(F.broadcast(any_named))
    return joined.select("date", F.when(F.col("_some"), F.col("_named")).otherwise(F.col("_mean")).alias("close"))


def tradable(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Members that have bars; if none has, every symbol with bars."""
    have = bars.select("symbol").distinct()
    both = have.join(members.select("symbol").distinct().withColumn("_member", F.lit(True)), "symbol", "left")
    some = both.agg(F.coalesce(F.bool_or("_member"), F.lit(False)).alias("_some"))
    return both.join(F.broadcast(some)).filter("_member or not _some").select("symbol")


def screen(panel: DataFrame, predicates: Sequence[Column | str], on_unknown: str = "error") -> DataFrame:
    """Adds eligible: all predicates hold; null never passes. on_unknown="skip" leaves out predicates over missing columns."""
    kept = []
    for p in predicates:
        column = F.expr(p) if isinstance(p, str) else p
        if on_unknown == "skip":
            try:
                panel.select(column)
            except Exception:  # the analyser names the unknown feature
                continue
        kept.append(column)
    return panel.withColumn("eligible", F.coalesce(reduce(lambda a, b: a & b, kept, F.lit(True)), F.lit(False)))


def exclude_sectors(df: DataFrame, terms: Sequence[str], cols: Sequence[str] = ("sector",)) -> DataFrame:
    """Rows whose sector (the first non-null of cols) holds none of the terms, whatever the case."""
    sector = F.lower(F.coalesce(*[F.col(c) for c in cols], F.lit("")))
    hit = reduce(lambda a, b: a | b, [sector.contains(t.strip().lower()) for t in terms], F.lit(False))
    return df.filter(~hit)


def gate_membership(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """eligible also asks for membership on the date, as (symbol, date, member) or as runs (symbol, from_date, to_date) that don't overlap.

    Runs meet rows by symbol and quarter, so a row is held against those runs only that its quarter touches.
    """
    if "from_date" not in membership.columns:
        flag = membership.groupBy("symbol", "date").agg(F.bool_or("member").alias("_member"))
        joined = panel.join(flag, ["symbol", "date"], "left")
        return joined.withColumn("eligible", F.col("eligible") & F.coalesce("_member", F.lit(False))).drop("_member")
    quarter = lambda c: F.year(c) * 4 + F.quarter(c)
    runs = membership.select(
        F.col("symbol").alias("_symbol"), "from_date", "to_date", F.explode(F.sequence(quarter("from_date"), quarter("to_date"))).alias("_quarter")
    )
    inside = (F.col("symbol") == F.col("_symbol")) & (quarter("date") == F.col("_quarter")) & F.col("date").between(F.col("from_date"), F.col("to_date"))
    joined = panel.join(runs, inside, "left").withColumn("eligible", F.col("eligible") & F.col("_symbol").isNotNull())
    return joined.drop("_symbol", "from_date", "to_date", "_quarter")


_PARAMETRIC = re.compile(r"^(sma|ema|roc|rsi|atr|adx|adtv|vol_avg|dist_high|rel_strength)(\d+)$")


def with_features(bars: DataFrame, names: Sequence[str], bench: DataFrame | None = None) -> DataFrame:
    """Adds the named features: sma50, ema20, roc21, rsi14, atr14, adx14, adtv20, vol_avg21, dist_high252, rel_strength63, macd,
    macd_signal, macd_hist, adtv_cr and ret_vol. Only those asked for are computed; an unknown name is an error."""
    close, volume = F.col("close"), F.col("volume")
    simple = {
        "sma": lambda n: ind.sma(close, n),
        "roc": lambda n: ind.roc(close, n),
        "adtv": lambda n: ind.adtv(close, volume, n),
        "vol_avg": lambda n: ind.volume_avg(volume, n),
        "dist_high": lambda n: ind.dist_from_high(close, n),
    }
    frames = {
        "ema": lambda df, n: ind.ema(df, "close", n),
        "rsi": ind.rsi,
        "atr": ind.atr,
        "adx": ind.adx,
        "rel_strength": lambda df, n: ind.rel_strength(df, bench, n),
    }
    out, plain = bars, {}
    for name in dict.fromkeys(names):
        found = _PARAMETRIC.match(name)
        if name in bars.columns:
            continue
        if name == "adtv_cr":
            plain[name] = ind.adtv_cr(close * volume)
        elif found and found[1] in simple:
            plain[name] = simple[found[1]](int(found[2]))
        elif not found and name not in ("macd", "macd_signal", "macd_hist", "ret_vol"):
            raise ValueError(f"unknown feature {name}")
    out = out.withColumns(plain) if plain else out
    for name in dict.fromkeys(names):
        found = _PARAMETRIC.match(name)
        if name in out.columns:
            continue
        if name.startswith("macd"):
            out = ind.macd(out)
        elif name == "ret_vol":
            out = ind.ret_vol(out)
        else:
            out = frames[found[1]](out, int(found[2]))
    return out

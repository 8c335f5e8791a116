"""Per-symbol time-series indicators over long bar frames.

Window expressions are columns; exponential averages need a join and so are functions from frame to frame. An
output is null until its window holds as many non-null inputs as it asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)


def by_symbol(keys: tuple[str, ...] = KEYS, date: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_symbol()).rowsBetween(-(n - 1), 0)


def rolling(fn, c: Column, n: int, least: int | None = None, w: WindowSpec | None = None) -> Column:
    """fn over the last n rows, null with fewer than `least` (n) values."""
    over = last_n(n, w)
    return F.when(F.count(c).over(over) >= (least or n), fn(c).over(over))


def sma(c: Column, n: int) -> Column:
    return rolling(F.avg, c, n)


def roc(c: Column, n: int) -> Column:
    """Rate of change over n rows in percent."""
    return (F.try_divide(c, F.lag(c, n).over(by_symbol())) - 1) * 100


def true_range(high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Null on a symbol's first bar."""
    h, lo, before = F.col(high), F.col(low), F.lag(close).over(by_symbol())
    return F.when(before.isNotNull(), F.greatest(h - lo, F.abs(h - before), F.abs(lo - before)))


def rolling_high(c: Column, n: int) -> Column:
    return rolling(F.max, c, n)


def rolling_low(c: Column, n: int) -> Column:
    return rolling(F.min, c, n)


def dist_from_high(c: Column, n: int = 252) -> Column:
    return F.try_divide(c, rolling_high(c, n)) - 1


def volume_avg(v: Column, n: int = 20) -> Column:
    return rolling(F.avg, v, n)


def adtv(close: Column, volume: Column, n: int = 20) -> Column:
    """Average daily traded value."""
    return rolling(F.avg, close * volume, n)


def adtv_cr(traded: Column, n: int = 20, least: int = 5) -> Column:
    """Average traded value in units of ten million, with a relaxed minimum of values."""
    return rolling(F.avg, traded, n, least) / 1e7


def daily_return(c: Column) -> Column:
    return F.try_divide(c, F.lag(c).over(by_symbol())) - 1


def ret_vol(df: DataFrame, c: str = "close", n: int = 20, least: int = 10, out: str = "ret_vol") -> DataFrame:
    """Adds ret_1 and the sample deviation of the last n of it."""
    df = df.withColumn("ret_1", daily_return(F.col(c)))
    return df.withColumn(out, rolling(F.stddev_samp, F.col("ret_1"), n, least))


def rel_strength(bars: DataFrame, bench: DataFrame, n: int = 63, out: str | None = None) -> DataFrame:
    """Adds (close / close n rows ago) / (benchmark / benchmark at that row's date); the benchmark's last value holds over gaps.

    bench (date, close) is one row a date, so it is a few thousand rows whatever the number of symbols.
    """
    out = out or f"rel_strength{n}"
    value = bench.select(F.col("date"), F.col("close").alias("_bench"))
    joined = bars.join(F.broadcast(value), "date", "left")
    w = by_symbol()
    joined = joined.withColumn("_bench", F.last("_bench", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.try_divide(F.col("close"), F.lag("close", n).over(w))
    of_bench = F.try_divide(F.col("_bench"), F.lag("_bench", n).over(w))
    return joined.withColumn(out, F.try_divide(own, of_bench)).drop("_bench")


def ewm(df: DataFrame, inputs: dict[str, str], alpha: float, least: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds exponentially weighted means y_0 = x_0, y_i = alpha * x_i + (1 - alpha) * y_(i-1); inputs maps output to input.

    Nulls may only lead a symbol's series. Rows are dealt into blocks as long as powers of (1 - alpha) stay in range; inside a
    block the recursion is a scaled running sum. Over a whole block the weight falls to 1e-12 at most, so the ends of the two
    blocks before are all that a block takes over; what lies further back weighs under 1e-24. Everything is windows over one
    partitioning, and no row carries more than two such ends.
    """
    keep = 1.0 - alpha
    block_rows = max(8, math.ceil(12 * math.log(10) / -math.log(keep))) if 0 < keep < 1 else 8
    w = by_symbol(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for i, out in enumerate(inputs):
        x, nth, block, pos, part, end = f"_x{i}", f"_n{i}", f"_b{i}", f"_p{i}", f"_s{i}", f"_e{i}"
        df = df.withColumn(x, F.col(inputs[out]))
        df = df.withColumn(nth, F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if keep <= 0:
            df = df.withColumn(out, F.when(F.col(nth) >= least, F.col(x))).drop(x, nth)
            continue
        df = df.withColumn(block, F.when(F.col(x).isNotNull(), F.floor((F.col(nth) - 1) / block_rows)).otherwise(F.lit(-1)))
        df = df.withColumn(pos, F.pmod(F.col(nth) - 1, F.lit(block_rows)))
        weight = F.when((F.col(nth) == 1), F.lit(1.0)).otherwise(F.lit(alpha))
        inside = Window.partitionBy(*keys, block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(part, F.sum(F.col(x) * weight * F.pow(F.lit(keep), -F.col(pos))).over(inside) * F.pow(F.lit(keep), F.col(pos)))
        ends = F.when((F.col(pos) == block_rows - 1) & F.col(x).isNotNull(), F.col(part))
        df = df.withColumn(end, ends)
        # each end with the one before it, so that one more look back finds both
        pair = F.when(F.col(end).isNotNull(), F.struct(F.col(end).alias("s"), F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0)).alias("t")))
        df = df.withColumn(end, pair)
        last = F.last(end, ignorenulls=True).over(before)
        carried = F.coalesce(last["s"] + last["t"] * F.lit(keep**block_rows), F.lit(0.0))
        value = F.col(part) + carried * F.pow(F.lit(keep), F.col(pos) + 1)
        df = df.withColumn(out, F.when(F.col(x).isNotNull() & (F.col(nth) >= least), value)).drop(x, nth, block, pos, part, end)
    return df


def ema(df: DataFrame, c: str, n: int, out: str | None = None) -> DataFrame:
    return ewm(df, {out or f"ema{n}": c}, 2.0 / (n + 1), n)


def rsi(df: DataFrame, n: int = 14, c: str = "close", out: str | None = None) -> DataFrame:
    """Wilder's index: 100 without losses but with gains, null without either."""
    change = F.col(c) - F.lag(c).over(by_symbol())
    df = df.withColumn("_up", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))))
    df = df.withColumn("_down", F.when(F.col("_up").isNotNull(), F.greatest(F.lag(c).over(by_symbol()) - F.col(c), F.lit(0.0))))
    df = ewm(df, {"_gain": "_up", "_loss": "_down"}, 1.0 / n, n)
    value = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), F.lit(100.0)).otherwise(
        100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(F.col("_gain"), F.col("_loss")))
    )
    return df.withColumn(out or f"rsi{n}", F.when(F.col(c).isNotNull(), value)).drop("_up", "_down", "_gain", "_loss")


def atr(df: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    df = df.withColumn("_tr", true_range())
    return ewm(df, {out or f"atr{n}": "_tr"}, 1.0 / n, n).drop("_tr")


def adx(df: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    """Average directional index; the first bar's movements are 0, a zero denominator gives no DX."""
    w = by_symbol()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = df.withColumn("_plus", F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)))
    df = df.withColumn("_minus", F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))
    df = df.withColumn("_tr", true_range())
    df = ewm(df, {"_atr": "_tr", "_p": "_plus", "_m": "_minus"}, 1.0 / n, n)
    plus, minus = 100 * F.try_divide(F.col("_p"), F.col("_atr")), 100 * F.try_divide(F.col("_m"), F.col("_atr"))
    df = df.withColumn("_dx", 100 * F.try_divide(F.abs(plus - minus), F.nullif(plus + minus, F.lit(0.0))))
    return ewm(df, {out or f"adx{n}": "_dx"}, 1.0 / n, n).drop("_plus", "_minus", "_tr", "_atr", "_p", "_m", "_dx")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, c: str = "close") -> DataFrame:
    """Adds macd, macd_signal and macd_hist."""
    df = ema(ema(df, c, fast, "_fast"), c, slow, "_slow")
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")

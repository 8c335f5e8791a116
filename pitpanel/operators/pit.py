"""Point-in-time joins: what was known at each date, never later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days of a block: a task sorts one block of a key's history, never all of it.
BLOCK_DAYS = 92


def _ticks(df: DataFrame, time: str) -> tuple[Column, int]:
    """A time column as a number, and how many make a day; plain numbers count as days."""
    kind = dict(df.dtypes)[time]
    if kind == "date":
        return F.unix_date(time).cast("long"), 1
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(time).cast("timestamp")), 86_400_000_000
    return F.col(time), 1


def asof_join(
    left: DataFrame, right: DataFrame, key: str | Sequence[str], left_time: str, right_time: str, how: str = "left",
    defaults: dict | None = None, forward: bool = False, exact: bool = True, within: int | None = None, block_days: int | None = BLOCK_DAYS,
) -> DataFrame:
    """left with the columns of the latest right row of its key whose right_time is at or before left_time.

    forward takes the earliest one at or after it; exact=False leaves out equal times, within bounds the days between. Rows of one
    right_time should be unique; of several the one with the greatest values counts. how="inner" drops left rows without a match;
    defaults fill nulls of right columns. A null time matches nothing.

    Both sides go through one shuffle and one sort by key and block of time, and the last right row so far is carried along, so
    neither matching pairs nor a key with much of the rows make a task grow. What goes over from block to block is worked out
    before, from the last right row of each block: a row for each key and block that left has. block_days=None sorts keys whole,
    which spares that where no key has much.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in right.columns if c not in keys]
    (left_ticks, day), (right_ticks, right_day) = _ticks(left, left_time), _ticks(right, right_time)
    if day != right_day:
        raise ValueError("both times must be dates, or both timestamps, or both numbers")
    sign = F.lit(-1 if forward else 1)
    block = lambda at: F.floor(at / F.lit((block_days or 1) * day)).cast("long") if block_days else F.lit(0).cast("long")
    side = 0 if exact else 1
    tag_left = left.select(*keys, (left_ticks * sign).alias("_at"), F.lit(1 - side).alias("_side"), F.struct(*left.columns).alias("_left"))
    tag_right = right.select(*keys, (right_ticks * sign).alias("_at"), F.lit(side).alias("_side"), F.struct(*values).alias("_values")).filter("_at is not null")
    tag_right = tag_right.select(*keys, "_at", "_side", F.struct("_at", "_values").alias("_right"))
    tag_left, tag_right = (x.withColumn("_block", block(F.col("_at"))) for x in (tag_left, tag_right))
    both = tag_right.unionByName(tag_left, allowMissingColumns=True)
    if block_days:
        last = tag_right.groupBy(*keys, "_block").agg(F.max("_right").alias("_last"))
        asked = tag_left.filter("_at is not null").select(*keys, "_block").distinct()
        w = Window.partitionBy(*keys).orderBy("_block", F.col("_last").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        carried = asked.unionByName(last, allowMissingColumns=True).withColumn("_right", F.last("_last", ignorenulls=True).over(w))
        carried = carried.filter("_last is null and _right is not null").select(*keys, "_right._at", F.lit(side).alias("_side"), "_right", "_block")
        both = both.unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    near = F.col("_at").isNotNull()
    if within is not None:
        near &= F.col("_at") - F.col("_found._at") <= within * day
    found = found.withColumn("_found", F.when(near, F.col("_found._values")))
    if how == "inner":
        found = found.filter("_found is not null")
    names = {c: c if c not in left.columns else f"{c}_right" for c in values}
    filled = {c: F.coalesce(F.col(f"_found.{c}"), F.lit(v)) for c, v in (defaults or {}).items()}
    return found.select("_left.*", *[filled.get(c, F.col(f"_found.{c}")).alias(names[c]) for c in values])


def pit_lagged(fund: DataFrame, panel: DataFrame, cols: Sequence[str], lag_days: int = 120) -> DataFrame:
    """panel with annual values known lag_days after their period's end; only rows of confidence high or low count."""
    if "roa" in cols and "roa" not in fund.columns:
        fund = fund.withColumn("roa", F.try_divide("net_profit_owner", "total_assets") * 100)
    known = fund.filter(F.col("confidence").isin("high", "low")).select(
        "symbol", F.date_add("period_end", lag_days).alias("known_from"), *cols
    )
    return asof_join(panel, known, "symbol", "date", "known_from")


def result_lag(periods: DataFrame, announcements: DataFrame, within: int = 100, fallback: int = 45) -> DataFrame:
    """id, period_end, available_from, matched and lag_days.

    Available from the earliest announcement in (period_end, period_end + within], else `fallback` days after the end. The nearest
    following announcement is carried back along a sort, so periods don't meet all announcements of their days.
    """
    ends = periods.select("id", "period_end").distinct()
    said = announcements.select("id", F.col("date").alias("_said")).distinct()
    first = asof_join(ends, said, "id", "period_end", "_said", forward=True, exact=False, within=within)
    return first.select(
        "id",
        "period_end",
        F.coalesce("_said", F.date_add("period_end", fallback)).alias("available_from"),
        F.col("_said").isNotNull().alias("matched"),
    ).withColumn("lag_days", F.datediff("available_from", "period_end"))


def pit_announced(eav: DataFrame, lag: DataFrame, panel: DataFrame, metric: str) -> DataFrame:
    """panel (id, date) with a metric's value known from its announcement; of one day the newest period counts, repeats averaged."""
    value = eav.filter(F.col("metric") == metric).groupBy("id", F.col("date").alias("period_end")).agg(F.avg("value").alias("value"))
    known = value.join(lag.select("id", "period_end", "available_from"), ["id", "period_end"])
    latest = known.groupBy("id", "available_from").agg(F.max_by("value", "period_end").alias("value"))
    return asof_join(panel, latest, "id", "date", "available_from")


def pit_snapshot(snap: DataFrame, panel: DataFrame, cols: Sequence[str]) -> DataFrame:
    """panel with the latest snapshot at or before each date; null before the first."""
    return asof_join(panel, snap.select("symbol", "snapshot_date", *cols), "symbol", "date", "snapshot_date")


def pit_universe(membership: DataFrame, asof, floor: float, days: int = 14) -> DataFrame:
    """Symbols whose last mcap in the `days` up to asof is above the floor."""
    day = F.lit(asof).cast("date")
    recent = membership.filter((F.col("date") >= F.date_sub(day, days)) & (F.col("date") <= day))
    return recent.groupBy("symbol").agg(F.max_by("mcap", "date").alias("mcap")).filter(F.col("mcap") > floor)


def _numbered(calendar: DataFrame) -> DataFrame:
    """date, its number from 0, and how many there are; a calendar has one row a date, so it is small."""
    days = calendar.select("date").filter("date is not null").distinct()
    numbered = days.withColumn("_no", F.row_number().over(Window.orderBy("date")) - 1)
    return F.broadcast(numbered.withColumn("_days", F.count("*").over(Window.partitionBy(F.lit(0))).cast("int")))


def _runs(membership: DataFrame, numbered: DataFrame, floor: float, limit: int) -> DataFrame:
    """symbol, _a and _b: numbers of the first and last date of each run of membership; they lie apart from each other."""
    w = Window.partitionBy("symbol").orderBy("_no", "mcap")
    dated = membership.select("symbol", "date", "mcap").filter("mcap is not null").join(numbered, "date")
    # A value counts until the day before the next one; of one day's values the greatest does.
    until = F.least(F.col("_no") + limit, F.coalesce(F.lead("_no").over(w) - 1, F.col("_days") - 1), F.col("_days") - 1)
    parts = dated.select("symbol", F.col("_no").alias("_a"), until.alias("_b"), "mcap").filter((F.col("_a") <= F.col("_b")) & (F.col("mcap") > floor))
    by_start = Window.partitionBy("symbol").orderBy("_a")
    begins = F.coalesce(F.col("_a") > F.lag("_b").over(by_start) + 1, F.lit(True))
    parts = parts.withColumn("_run", F.sum(begins.cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("symbol", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).drop("_run")


def membership_runs(membership: DataFrame, calendar: DataFrame, floor: float, limit: int = 10) -> DataFrame:
    """symbol, from_date and to_date of the runs of calendar dates on which mcap, carried forward at most `limit` of them, is above the floor.

    Gaps and islands over the rows there are: nothing grows with symbols times dates. Values on dates outside of the calendar don't count.
    """
    numbered = _numbered(calendar)
    day = lambda no, name: numbered.select(F.col("_no").alias(no), F.col("date").alias(name))
    runs = _runs(membership, numbered, floor, limit)
    return runs.join(F.broadcast(day("_a", "from_date")), "_a").join(F.broadcast(day("_b", "to_date")), "_b").select("symbol", "from_date", "to_date")


def membership_panel(membership: DataFrame, calendar: DataFrame, floor: float, limit: int = 10) -> DataFrame:
    """symbol, date and member on every calendar date: mcap carried forward at most `limit` rows is above the floor.

    Runs of membership and the gaps between them are worked out from the rows there are; only they are shuffled, and the grid is
    written out from them in place.
    """
    numbered = _numbered(calendar)
    end = numbered.agg(F.max("_days").alias("_days"))
    symbols = membership.select("symbol").distinct().join(F.broadcast(end)).select("symbol", F.col("_days").alias("_a"), F.lit(None).cast("int").alias("_b"))
    runs = _runs(membership, numbered, floor, limit).union(symbols).filter("symbol is not null")
    runs = runs.withColumn("_gap", F.coalesce(F.lag("_b").over(Window.partitionBy("symbol").orderBy("_a")) + 1, F.lit(0)))
    days = lambda a, b: F.when(a <= b, F.sequence(a, b))
    spans = F.array(
        F.struct(days(F.col("_gap"), F.col("_a") - 1).alias("days"), F.lit(False).alias("member")), F.struct(days(F.col("_a"), F.col("_b")).alias("days"), F.lit(True).alias("member"))
    )
    grid = runs.select("symbol", F.inline(spans)).select("symbol", "member", F.explode("days").alias("_no"))
    return grid.join(numbered.select("_no", "date"), "_no").select("symbol", "date", "member")


def universe_over_window(membership: DataFrame, start, end, floor: float) -> DataFrame:
    """Symbols that were above the floor at any time in the window."""
    inside = membership.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy("symbol").agg(F.max("mcap").alias("peak")).filter(F.col("peak") > floor)


def latest_flags(surveillance: DataFrame) -> DataFrame:
    """Of the latest fetch_date: a list of (list_type, stage) for each symbol."""
    last = surveillance.agg(F.max("fetch_date").alias("fetch_date"))
    rows = surveillance.join(F.broadcast(last), "fetch_date")
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_set(F.struct("list_type", "stage"))).alias("flags"))


def latest_close(bars: DataFrame) -> DataFrame:
    """The last date with a price, and the price: adj_close, or close where that is null."""
    price: Column = F.coalesce("adj_close", "close")
    priced = bars.select("symbol", "date", price.alias("_p")).filter("_p is not null")
    return priced.groupBy("symbol").agg(F.max("date").alias("last_date"), F.max_by("_p", "date").alias("last_close"))

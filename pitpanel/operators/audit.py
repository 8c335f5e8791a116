"""Audits of bars, keys, coverage and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.indicators import daily_return


def coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


def universe_coverage(members: DataFrame, delistings: DataFrame, days: int = 14) -> DataFrame:
    """ever, now (a row in the last `days`) and delisted: numbers of symbols."""
    last = F.broadcast(members.agg(F.max("date").alias("_end")))
    marked = members.join(last).join(delistings.select("symbol", F.lit(True).alias("_gone")).distinct(), "symbol", "left")
    return marked.agg(
        F.countDistinct("symbol").alias("ever"),
        F.countDistinct(F.when(F.col("date") >= F.date_sub("_end", days), F.col("symbol"))).alias("now"),
        F.countDistinct(F.when(F.col("_gone"), F.col("symbol"))).alias("delisted"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def bad_values(df: DataFrame) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    return df.agg(
        F.count_if(bad("close")).alias("bad_close"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(bad("adj_close")).alias("bad_adj_close"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
    )


def return_outliers(df: DataFrame, threshold: float = 0.5, k: int = 25) -> DataFrame:
    """The k largest one-bar moves over the threshold."""
    moves = df.withColumn("ret", daily_return(F.col("close"))).filter(F.abs("ret") > threshold)
    return moves.select("symbol", "date", "ret").orderBy(F.desc(F.abs("ret")), "symbol", "date").limit(k)


def stale_symbols(df: DataFrame, days: int = 10) -> DataFrame:
    last = df.groupBy("symbol").agg(F.max("date").alias("last_date"))
    end = F.broadcast(df.agg(F.max("date").alias("_end")))
    return last.join(end).filter(F.col("last_date") < F.date_sub("_end", days)).drop("_end")


def thin_symbols(df: DataFrame, n: int = 250) -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("n_bars")).filter(F.col("n_bars") < n)


def join_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_both, n_left_only, n_right_only distinct keys; left_only(a, b, key) lists them."""
    left = a.select(key).dropna().distinct().withColumn("_a", F.lit(1))
    right = b.select(key).dropna().distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_a").isNull()).alias("n_right_only"),
    )


def left_only(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def null_rates(df: DataFrame) -> DataFrame:
    """field, n_null and rate of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in df.columns])).alias("x"))
    return long.select("x.field", "x.n_null", F.coalesce(F.try_divide("x.n_null", "_n"), F.lit(0.0)).alias("rate"))


def benchmark_health(df: DataFrame, pattern: str = "^%", least: int = 2000) -> DataFrame:
    found = df.filter(F.col("symbol").cast("string").like(pattern)).groupBy("symbol")
    per = found.agg(F.count("*").alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per.withColumn("healthy", F.col("n_bars") > least)


def _stacked(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("has")) for c in features]))
    keep = [c for c in ("symbol", "date") if c in panel.columns]
    return panel.select(*keep, each.alias("x")).select(*keep, "x.feature", "x.has").filter("has")


def feature_coverage(panel: DataFrame, features: Sequence[str], sources: Mapping[str, str] | None = None) -> DataFrame:
    """feature, source, first_date, last_date, n: where each feature has data; a feature without any has no row."""
    found = _stacked(panel, features).groupBy("feature").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    source = F.lit("price")
    for name, of in (sources or {}).items():
        source = F.when(F.col("feature") == name, F.lit(of)).otherwise(source)
    return found.withColumn("source", source)


def readiness(cov: DataFrame, used: Mapping[str, str], start: str) -> DataFrame:
    """One row with the verdict for features used in a "filter" or a "rank" from a start date on.

    A filter feature without any data blocks; one whose data begin after the start makes a strategy live-only; a rank feature late or
    missing leaves what prices support ("price-backtestable") if the filters are fine; all there is fully-backtestable, or
    backtestable if only rank features begin late.
    """
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(u).alias("use")) for f, u in used.items()])
    asked = cov.sparkSession.range(1).select(F.explode(rows).alias("x")).select("x.*").join(cov, "feature", "left")
    missing = F.col("first_date").isNull()
    late = F.coalesce(F.col("first_date") > F.lit(start).cast("date"), F.lit(False))
    is_filter = F.col("use") == "filter"
    sums = asked.agg(
        F.count_if(is_filter & missing).alias("fm"), F.count_if(is_filter & late).alias("fl"), F.count_if(~is_filter & missing).alias("rm"), F.count_if(~is_filter & late).alias("rl")
    )
    verdict = (
        F.when(F.col("fm") > 0, "blocked")
        .when(F.col("fl") > 0, "live-only")
        .when(F.col("rm") > 0, "price-backtestable")
        .when(F.col("rl") > 0, "backtestable")
        .otherwise("fully-backtestable")
    )
    return sums.select(verdict.alias("verdict"), F.col("fm").alias("filters_missing"), F.col("fl").alias("filters_late"), F.col("rm").alias("ranks_missing"), F.col("rl").alias("ranks_late"))


def snapshot_coverage(df: DataFrame, today, max_age: int = 35) -> DataFrame:
    sums = df.agg(F.countDistinct("snapshot_date").alias("n_snapshots"), F.countDistinct("symbol").alias("n_symbols"), F.max("snapshot_date").alias("latest"))
    age = F.datediff(F.lit(today).cast("date"), "latest")
    return sums.withColumn("age", age).withColumn("stale", age > max_age)


def lag_stats(lag: DataFrame) -> DataFrame:
    """n, matched share, and median, p10, p90 of the matched rows' lag."""
    found = exact_quantiles(lag.filter("matched"), [], "lag_days", (0.1, 0.5, 0.9))
    at = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
    sums = lag.agg(F.count("*").alias("n"), F.avg(F.col("matched").cast("double")).alias("matched"))
    return sums.join(found.agg(at(0.5, "median"), at(0.1, "p10"), at(0.9, "p90")))  # one row each


def integrity_checks(bars: DataFrame, adjusted: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """symbol, total return by adjusted closes and by adj_close, and whether they agree."""
    total = lambda df, c, name: df.filter(F.col(c).isNotNull()).groupBy("symbol").agg((F.try_divide(F.max_by(c, "date"), F.min_by(c, "date")) - 1).alias(name))
    joined = total(adjusted, "close", "adjusted_return").join(total(bars, "adj_close", "raw_return"), "symbol")
    return joined.withColumn("ok", F.abs(F.col("adjusted_return") - F.col("raw_return")) <= tolerance)


def tolerance_check(result: DataFrame, reference: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """metric, value, expected, diff and status (ok, off or missing) of two tables (metric, value)."""
    joined = reference.withColumnRenamed("value", "expected").join(result, "metric", "left")
    diff = F.col("value") - F.col("expected")
    status = F.when(diff.isNull(), "missing").when(F.abs(diff) <= tolerance, "ok").otherwise("off")
    return joined.select("metric", "value", "expected", diff.alias("diff"), status.alias("status"))


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def survivorship_coverage(panel: DataFrame, delistings: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, n_dead (values for delisted symbols) and survivors_only."""
    dead = panel.join(delistings.select("symbol").distinct(), "symbol", "left_semi")
    counts = dead.agg(*[F.count(c).alias(c) for c in features])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_dead")) for c in features])).alias("x"))
    return long.select("x.*").withColumn("survivors_only", F.col("n_dead") == 0)


def uncertain_count(universe: DataFrame, delistings: DataFrame) -> DataFrame:
    inside = delistings.join(universe.select("symbol").distinct(), "symbol", "left_semi")
    return inside.agg(F.count_if("ca_uncertain").alias("n_uncertain"), F.count("*").alias("n_delisted"))



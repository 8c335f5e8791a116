"""Exact quantiles with buffers of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks that the sketch may be wrong by, as a share of the rows: one in so many.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """by, prob and quantile (interpolated between neighbours) of the non-null values of each group; groups without any are left out.

    A mergeable sketch brackets each rank, with three times the error that it may have on either side. A second pass counts the rows below
    the bracket and, one by one, the values inside, a few in ten thousand rows; the rank is read off these. So no buffer holds a
    group's values, however many and different they are, and repeated values cost one row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    slack = 3 / ACCURACY
    few = F.count("*") < ACCURACY  # whose ranks lie further apart than the slack
    low = [F.min("_v") if p <= slack else F.when(few, F.min("_v")).otherwise(F.percentile_approx("_v", p - slack, ACCURACY)) for p in probs]
    high = [F.max("_v") if p >= 1 - slack else F.when(few, F.max("_v")).otherwise(F.percentile_approx("_v", p + slack, ACCURACY)) for p in probs]
    ends = [F.struct(F.lit(float(p)).alias("prob"), a.alias("_low"), b.alias("_high")) for p, a, b in zip(probs, low, high, strict=True)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*ends).alias("_ends")).filter("_n > 0")
    asked = sketch.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n", F.inline("_ends"))
    place = F.col("prob") * (F.col("_n") - 1)
    asked = asked.withColumns({"_first": F.floor(place), "_second": F.ceil(place), "_share": place - F.floor(place)})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    met = rows.join(asked, same or F.lit(True)).filter("_v <= _high")
    inside = met.groupBy(*by, "prob", "_first", "_second", "_share", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*by, "prob").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_upto", upto).filter("_v is not null")
    at = lambda rank: F.max(F.when((F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_rows")), F.col("_v")))
    found = ranked.groupBy(*by, "prob", "_share").agg(at("_first").alias("_a"), at("_second").alias("_b"))
    missed = F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")
    return found.select(*by, "prob", F.coalesce(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share"), missed).alias("quantile"))

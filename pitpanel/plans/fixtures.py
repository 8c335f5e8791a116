"""Panels that Spark derives from the star-schema tables, and the same derivations as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcomes import month_number


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bars(lines: DataFrame, symbol: str, keys: Sequence[str] = ()) -> DataFrame:
    px = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "px", "l_quantity", "l_discount")
    rows = lines.withColumn("px", px).select(
        F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("date"), *keys, "px", key.alias("k"), "l_quantity", "l_extendedprice",
        (F.col("px") * (1 - F.col("l_discount"))).alias("adj"),
    )
    return rows.groupBy("symbol", "date", *keys).agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"),
        F.max_by("adj", "k").alias("adj_close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )


def bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(table(spark, d, "lineitem"), "l_suppkey")


def bars_by_month(spark: SparkSession, d: str) -> DataFrame:
    """bars with their month, parted by symbol and month from the start, so that what groups by these moves no bar again."""
    lines = table(spark, d, "lineitem").withColumn("month", month_number("l_shipdate"))
    return _bars(lines.repartition("l_suppkey", "month"), "l_suppkey", ["month"])


def brand_bars(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return _bars(table(spark, d, "lineitem").join(part, "l_partkey"), "p_brand")


def sectors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"))


def bench(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).groupBy("date").agg(F.avg("close").alias("close"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("symbol"), quarter.alias("from_date")).agg(F.sum("l_quantity").alias("shares"))


def eav(spark: SparkSession, d: str) -> DataFrame:
    end = F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 3), 1)
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), end.alias("date")).agg(
        F.sum("o_totalprice").alias("np"), F.count("*").cast("double").alias("eps")
    )
    pairs = F.explode(F.array(F.struct(F.lit("NP").alias("metric"), F.col("np").alias("value")), F.struct(F.lit("EPS").alias("metric"), F.col("eps").alias("value"))))
    return per.select("id", "date", pairs.alias("x")).select("id", "date", "x.metric", "x.value")


def announcements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date")).distinct()


def nav(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("variant"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("nav"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    px = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O' and l_linenumber = 1")
    return lines.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("position_id"),
        F.col("l_returnflag").alias("strategy_id"), F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("entry_date"),
        px.alias("entry"), (px * (0.9 - F.col("l_discount"))).alias("stop"), (px * (1.1 + F.col("l_tax"))).alias("target"),
        F.floor(F.lit(15000.0) / px).alias("shares"), F.lit("open").alias("status"),
    )


def mcap(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.actions import pit_mcap_asof

    return pit_mcap_asof(bars(spark, d), shares(spark, d).withColumnRenamed("from_date", "date"))


def surveillance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.to_date("ts").alias("fetch_date"), F.col("user_id").alias("symbol"), F.col("event_type").alias("list_type"),
        F.get_json_object("props", "$.k").alias("stage"),
    )


_BARS = """SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date,
  arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, arg_max(px * (1 - l_discount), k) AS adj_close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover
  FROM (SELECT *, l_extendedprice / l_quantity AS px,
        row(l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity, l_quantity, l_discount) AS k FROM {source}) GROUP BY ALL"""

#: CTEs of the panels above, to stand in front of a query.
SQL = f"""
bars AS ({_BARS.format(symbol="l_suppkey", source="lineitem")}),
brands AS ({_BARS.format(symbol="p_brand", source="lineitem JOIN part ON l_partkey = p_partkey")}),
sectors AS (SELECT s_suppkey AS symbol, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bench AS (SELECT date, avg(close) AS close FROM bars GROUP BY date),
shares AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS from_date, sum(l_quantity) AS shares FROM lineitem GROUP BY ALL),
quarters AS (SELECT o_custkey AS id, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date,
  sum(o_totalprice) AS np, CAST(count(*) AS DOUBLE) AS eps FROM orders GROUP BY ALL),
eav AS (SELECT id, date, 'NP' AS metric, np AS value FROM quarters UNION ALL SELECT id, date, 'EPS', eps FROM quarters),
ann AS (SELECT DISTINCT o_custkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders),
nav AS (SELECT o_orderpriority AS variant, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS nav FROM orders GROUP BY ALL),
positions AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position_id, l_returnflag AS strategy_id, l_suppkey AS symbol,
  CAST(l_shipdate AS DATE) AS entry_date, px AS entry, px * (0.9 - l_discount) AS stop, px * (1.1 + l_tax) AS target, floor(15000.0 / px) AS shares
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 1)),
mcap AS (SELECT b.symbol, b.date, b.close * s.shares AS mcap FROM bars b ASOF JOIN shares s ON b.symbol = s.symbol AND b.date >= s.from_date),
surv AS (SELECT CAST(ts AS DATE) AS fetch_date, user_id AS symbol, event_type AS list_type, json_extract_string(props, '$.k') AS stage FROM events)
"""

"""Registered queries over file readers, partition writers and streams, by way of tables that Spark derives from the reference tables.

Files go to the shared folder, in a path of their own for each call, and stay until that folder is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.scratch import new_path
from ..streaming import jobs
from . import fixtures as fx
from .catalog import C, query, r


def _raw_legacy(s, d) -> DataFrame:
    """Bars as the older format has them: padded text, some of other series, some without a number for the close."""
    series = F.when(C("symbol") % 4 == 0, "EQ").when(C("symbol") % 4 == 1, " BE").when(C("symbol") % 4 == 2, "SM ").otherwise("GS")
    close = F.when((C("symbol") % 4 == 2) & (C("volume") > 30), "n/a").otherwise(F.concat(F.lit(" "), C("close").cast("string")))
    return fx.bars(s, d).select(
        F.concat(F.lit(" sup"), "symbol", F.lit(".NS ")).alias("SYMBOL"), series.alias(" SERIES"), C("open").cast("string").alias("OPEN"), close.alias("CLOSE "),
        C("volume").cast("string").alias("TOTTRDQTY"), F.date_format("date", "dd-MMM-yyyy").alias("TIMESTAMP"), F.lit("-").alias("LAST"),
    )


def _raw_udiff(s, d) -> DataFrame:
    series = F.when(C("symbol") % 2 == 0, "EQ").otherwise("ST")
    return fx.bars(s, d).select(
        F.concat(F.lit("sup"), "symbol").alias("TckrSymb"), series.alias("SctySrs"), C("open").cast("string").alias("OpnPric"), C("close").cast("string").alias("ClsPric"),
        C("turnover").cast("string").alias("TtlTrfVal"), F.date_format("date", "yyyy-MM-dd").alias("TradDt"), F.lit("7").alias("TtlNbOfTxsExctd"),
    )


_LEGACY = """SELECT 'SUP' || symbol AS symbol, date, CASE symbol % 4 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BE' ELSE 'SM' END AS series, open, close, volume, CAST(NULL AS DOUBLE) AS turnover
FROM bars WHERE symbol % 4 < 3 AND NOT (symbol % 4 = 2 AND volume > 30)"""
_UDIFF = """SELECT 'SUP' || symbol AS symbol, date, CASE WHEN symbol % 2 = 0 THEN 'EQ' ELSE 'ST' END AS series, open, close, CAST(NULL AS DOUBLE) AS volume, turnover FROM bars"""
_FIELDS = ("symbol", "date", "series", "open", "close", "volume")


@query(f"SELECT symbol, date, series, open, close, volume FROM ({_LEGACY})")
def a1_bars_legacy(s, d):
    return readers.legacy_bars(_raw_legacy(s, d)).select(*_FIELDS)


@query(f"SELECT symbol, date, series, open, close, round(turnover, 3) AS turnover FROM ({_UDIFF})")
def a2_bars_udiff(s, d):
    return readers.udiff_bars(_raw_udiff(s, d)).select("symbol", "date", "series", "open", "close", r("turnover", 3))


@query(f"SELECT symbol, date, series, open, close, volume FROM ({_LEGACY}) WHERE date < DATE '1997-03-03' UNION ALL SELECT symbol, date, series, open, close, volume FROM ({_UDIFF}) WHERE date >= DATE '1997-03-03'")
def a3_bars_of_both_formats(s, d):
    """By way of files: both formats are written and read back whole, and the cut-over date picks from each."""
    old, new = new_path(s, "legacy-bars"), new_path(s, "udiff-bars")
    _raw_legacy(s, d).write.options(header=True, compression="gzip").csv(old)
    _raw_udiff(s, d).write.options(header=True, compression="gzip").csv(new)
    return readers.read_bars(s, old, new, "1997-03-03").select(*_FIELDS)


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, 'said \"' || o_orderpriority || '\", twice' || chr(10) || 'or so' AS note FROM orders")
def a4_csv_table(s, d):
    path = new_path(s, "csv-table")
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('", twice\nor so'))
    rows = fx.table(s, d, "orders").select(C("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), C("o_totalprice").alias("price"), note.alias("note"))
    rows.write.options(header=True, escape='"').csv(path)
    return readers.read_csv_table(s, path, rows.schema, multi_line=True)


@query("SELECT symbol, from_date AS snapshot_date, CASE WHEN from_date >= DATE '1997-01-01' THEN shares * 2 ELSE shares END AS shares FROM shares WHERE from_date < DATE '1997-01-01' OR symbol % 2 = 0")
def a10_replace_partition(s, d):
    """All snapshots are written, then those from 1997 on replaced by others of fewer symbols."""
    path = new_path(s, "snapshots")
    rows = fx.shares(s, d).withColumnRenamed("from_date", "snapshot_date")
    readers.replace_partition(rows.repartition("snapshot_date"), path)
    later = rows.filter("snapshot_date >= date'1997-01-01' and symbol % 2 = 0").withColumn("shares", C("shares") * 2)
    readers.replace_partition(later.repartition("snapshot_date"), path)
    return s.read.schema(rows.schema).parquet(path).select("symbol", "snapshot_date", "shares")


def _bar_files(s, d) -> str:
    """Daily rows as files of two batches: all bars, then corrections of those with much volume."""
    path = new_path(s, "bar-stream")
    b = fx.bars(s, d).select(C("symbol").cast("string").alias("symbol"), "date", "open", "high", "low", "close", "volume")
    b.withColumn("ingested_at", F.to_timestamp(F.date_add("date", 1))).write.parquet(path)
    fixed = s.read.parquet(path).filter("volume > 40").withColumn("close", C("close") * 2)  # the files of the first batch, not derived again
    fixed.withColumn("ingested_at", F.to_timestamp(F.date_add("date", 2))).write.mode("append").parquet(path)
    return path


@query("SELECT CAST(symbol AS VARCHAR) AS symbol, date, CASE WHEN volume > 40 THEN close * 2 ELSE close END AS close FROM bars")
def m1_stream_bars(s, d):
    target = new_path(s, "bar-table")
    jobs.stream_bars(s, _bar_files(s, d), target, new_path(s, "bar-offsets")).awaitTermination()
    return s.read.parquet(target).select("symbol", "date", "close")


@query("""SELECT DISTINCT position_id, CASE WHEN close <= stop THEN 'stop_hit' ELSE 'target_hit' END AS reason
FROM positions JOIN (SELECT symbol, close FROM bars UNION ALL SELECT symbol, close * 2 FROM bars WHERE volume > 40) USING (symbol) WHERE close <= stop OR close >= target""")
def m2_stream_alerts(s, d):
    """One alert for each position and reason, however often and long a level is passed."""
    source, target = _bar_files(s, d), new_path(s, "alerts")
    bars = s.readStream.schema(jobs.BAR_SCHEMA).parquet(source).select(C("symbol").cast("long").alias("symbol"), F.to_timestamp("date").alias("ts"), "close")
    alerts = jobs.stream_alerts(bars, fx.positions(s, d))
    stream = alerts.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_path(s, "alert-offsets"))
    stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(alerts.schema).parquet(target).select("position_id", "reason")


@query("""SELECT DISTINCT position_id, CASE WHEN close <= stop THEN 'stop_hit' ELSE 'target_hit' END AS reason
FROM positions p JOIN bars b ON b.symbol = p.symbol AND b.date >= entry_date AND b.date < entry_date + 90 WHERE close <= stop OR close >= target""")
def m2_follow_alerts(s, d):
    """Positions come as a stream too: each is opened at its entry and closed 90 days later."""
    prices, events, target = new_path(s, "bar-stream"), new_path(s, "position-events"), new_path(s, "followed-alerts")
    fx.bars(s, d).select("symbol", F.to_timestamp("date").alias("ts"), "close").write.parquet(prices)
    opened = fx.positions(s, d).select("position_id", "symbol", F.to_timestamp("entry_date").alias("ts"), "status", "stop", "target")
    opened.write.parquet(events)
    opened.withColumns({"ts": C("ts") + F.expr("interval 90 days"), "status": F.lit("closed")}).write.mode("append").parquet(events)
    stream = lambda path: s.readStream.schema(s.read.parquet(path).schema).parquet(path)
    alerts = jobs.follow_alerts(stream(prices), stream(events))
    writer = alerts.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_path(s, "followed-offsets"))
    jobs.start_with_state(s, writer.outputMode("append").trigger(availableNow=True)).awaitTermination()
    return s.read.schema(jobs.ALERT_SCHEMA).parquet(target).select("position_id", "reason")

"""Incremental jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..sources.readers import newest_by_key

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, ingested_at timestamp"


def stream_bars(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = BAR_SCHEMA) -> StreamingQuery:
    """Upserts daily rows from parquet files into a table partitioned by year; the row ingested last wins.

    A batch rewrites only the years that it touches, staged beside the table first, so a replay gives the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.withColumn("year", F.year("date"))
        years = [r["year"] for r in fresh.select("year").distinct().collect()]  # the years of one batch
        if not years:
            return
        keys = ["symbol", "date"]
        try:
            base = session.read.schema(fresh.schema).parquet(target).filter(F.col("year").isin(years))
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            base = session.createDataFrame([], fresh.schema)
        later = newest_by_key(base.unionByName(fresh), keys, "ingested_at")
        staged = f"{target}_staged"
        later.write.mode("overwrite").parquet(staged)
        session.read.schema(fresh.schema).parquet(staged).write.partitionBy("year").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(target)

    return (
        spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


_PRICE = ["symbol", "ts", "close"]


def _records(parts: Iterator[pd.DataFrame], least: int = 100_000) -> Iterator[pd.DataFrame]:
    """The bars of each symbol that close below or above all before them, with the lowest and the highest close before."""
    kept, waiting, n = pd.DataFrame(), [], 0

    def thinned() -> pd.DataFrame:  # records of records are records, so parts may come in any order
        rows = pd.concat([kept[_PRICE], *waiting] if len(kept) else waiting, ignore_index=True).sort_values(["symbol", "ts"], kind="stable", ignore_index=True)
        by = rows.groupby("symbol", sort=False)
        rows["lowest"], rows["highest"] = (x.groupby(rows["symbol"], sort=False).shift() for x in (by["close"].cummin(), by["close"].cummax()))
        return rows[rows["lowest"].isna() | (rows["close"] < rows["lowest"]) | (rows["close"] > rows["highest"])]

    for part in parts:
        waiting.append(part)
        n += len(part)
        if n > max(least, len(kept)):
            kept, waiting, n = thinned(), [], 0
    if waiting:
        kept = thinned()
    if len(kept):
        yield kept


def stream_alerts(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """position_id, symbol, reason, price, ts: one alert for each open position and reason, from a stream of bars (symbol, ts, close).

    What has been said is kept for good, so a position that stays below its stop isn't said again however long it does; that state
    has at most two rows for each position. Late bars count like any other. In a batch the first bar beyond a level is one that
    closes beyond all before it, so positions meet those few and not all bars of their symbol, and only the first is looked up in the state.
    A close that isn't a number is no price.
    """
    kind = dict(bars.dtypes)["symbol"]
    open_ = positions.filter("status = 'open'").select("position_id", "symbol", "stop", "target")
    prices = bars.filter("close is not null and not isnan(close)").select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("close").cast("double").alias("close"))
    records = prices.repartition("symbol").mapInPandas(_records, f"symbol {kind}, ts timestamp, close double, lowest double, highest double")
    joined = records.join(open_, "symbol")
    at_stop = F.coalesce(F.col("close") <= F.col("stop"), F.lit(False))
    before = F.coalesce(F.col("lowest") <= F.col("stop"), F.lit(False))
    at_target = ~at_stop & (F.col("close") >= F.col("target"))
    above = (F.col("highest") >= F.col("target")) & ~F.coalesce(F.col("highest") <= F.col("stop"), F.lit(False))
    reason = F.when(at_stop & ~before, "stop_hit").when(at_target & ~F.coalesce(above, F.lit(False)), "target_hit")
    hits = joined.withColumn("reason", reason).filter("reason is not null")
    return hits.select("position_id", "symbol", "reason", F.col("close").alias("price"), "ts").dropDuplicates(["position_id", "reason"])


ALERT_SCHEMA = "position_id string, symbol string, reason string, price double, ts timestamp"
_SAID = "position_id string, symbol string, reason string, price double, at long"
_HELD = "symbol string, position_id string, stop double, target double, opened long, said_stop boolean, said_target boolean"


class _Levels(StatefulProcessor):
    """The open positions of a group of symbols (or of one share of them) and which of their levels have been said; times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        news = pd.concat(list(rows), ignore_index=True)
        is_bar = news["position_id"].isna()
        bars, changes = news[is_bar], news[~is_bar]
        codes, symbols = pd.factorize(bars["symbol"])
        order = np.lexsort((bars["at"], codes))  # the bars of one time stay in the order they came in
        at, prices = bars["at"].to_numpy()[order], bars["close"].to_numpy(float)[order]
        edges = np.searchsorted(codes[order], np.arange(len(symbols) + 1))
        own = {symbol: (at[a:z], prices[a:z]) for symbol, a, z in zip(symbols, edges, edges[1:])}
        held = {r[:2]: r for r in (tuple(r) for r in self.held.get())}
        is_open = changes["status"] == "open"
        for r in changes[is_open].sort_values("at", kind="stable").itertuples(index=False):
            held.setdefault((r.symbol, r.position_id), (r.symbol, r.position_id, r.stop, r.target, r.at, False, False))
        closed = changes[~is_open].sort_values("at")
        closed = dict(zip(zip(closed["symbol"], closed["position_id"]), closed["at"]))
        said, still, none = [], [], (at[:0], prices[:0])
        for place, (symbol, id_, stop, target, since, said_stop, said_target) in held.items():
            until = closed.get(place)
            when, close = own.get(symbol, none)
            begin = int(when.searchsorted(since))
            live = close[begin : len(when) if until is None else max(begin, int(when.searchsorted(until)))]
            at_stop = live <= (np.nan if stop is None else stop)
            at_target = ~at_stop & (live >= (np.nan if target is None else target))
            hit_stop, hit_target = bool(at_stop.any()), bool(at_target.any())
            for already, hit, days, reason in ((said_stop, hit_stop, at_stop, "stop_hit"), (said_target, hit_target, at_target, "target_hit")):
                if hit and not already:
                    first = int(days.argmax())
                    said.append((id_, symbol, reason, live[first], when[begin + first]))
            if until is None:
                still.append((symbol, id_, stop, target, since, said_stop or hit_stop, said_target or hit_target))
        if still:
            self.held.put(still)
        else:
            self.held.clear()
        yield pd.DataFrame(said, columns=["position_id", "symbol", "reason", "price", "at"])

    def close(self) -> None:
        pass


def follow_alerts(bars: DataFrame, changes: DataFrame, shares: int = 1, groups: int = 4096) -> DataFrame:
    """position_id, symbol, reason, price, ts: the first stop and the first target hit of each position, while it is open.

    bars is a stream of (symbol, ts, close), changes one of (position_id, symbol, ts, status, stop, target): `open` opens a position, anything else
    closes it. A bar counts from the time of opening on and before that of closing, and of both levels the stop. State holds open
    positions only: closing frees it, and a position opened while the job runs is followed from then on. A batch takes
    its rows by time, whatever order they came in; bars that come in a later batch than the closing aren't held against it, and a
    position is opened once. Without a symbol there is nothing to follow, and an opening or a bar without a time is none.

    Symbols are dealt to so many groups, each with one list in the state: a call costs as much for one symbol as for a hundred. A group's rows of a
    batch are in memory at once. shares parts symbols with very many positions, each with a copy of its bars. A checkpoint is for one number of both.
    """
    group = F.pmod(F.xxhash64("symbol"), F.lit(groups)).cast("int").alias("group")
    share = F.pmod(F.xxhash64("position_id"), F.lit(shares)).cast("int").alias("share")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    known = changes.filter("position_id is not null and symbol is not null").withColumn("symbol", F.col("symbol").cast("string"))
    # a closing without a time closes before all bars
    events = known.filter("ts is not null or not status <=> 'open'").select(
        group, share, "symbol", F.coalesce(at, F.lit(-(2**63))).alias("at"), F.lit(None).cast("double").alias("close"),
        F.col("position_id").cast("string").alias("position_id"), "status", F.col("stop").cast("double").alias("stop"), F.col("target").cast("double").alias("target"),
    )
    priced = bars.filter("close is not null and symbol is not null and ts is not null").withColumn("symbol", F.col("symbol").cast("string"))
    prices = priced.select(
        group, F.explode(F.array(*[F.lit(k) for k in range(shares)])).alias("share"), "symbol", at.alias("at"),
        F.col("close").cast("double").alias("close"), *[F.lit(None).cast(kind).alias(c) for c, kind in (("position_id", "string"), ("status", "string"), ("stop", "double"), ("target", "double"))],
    )
    both = events.unionByName(prices)
    said = both.groupBy("group", "share").transformWithStateInPandas(_Levels(), _SAID, "Append", "None")
    return said.select("position_id", "symbol", "reason", "price", F.timestamp_micros("at").alias("ts"))


def start_with_state(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query whose state needs a store that keeps more than fits in memory; the session's own choice stays as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

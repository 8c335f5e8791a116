"""The position book and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pit import latest_close


def open_positions(signals: DataFrame, capital: float, strategy_id: str | None = None) -> DataFrame:
    """Positions of buy signals (symbol, date, price, stop, target): whole shares that the capital of each buys."""
    buys = signals.filter("action = 'buy' and price > 0")
    sid = F.lit(strategy_id) if strategy_id is not None else F.lit(None).cast("string")
    return buys.select(
        F.concat_ws("|", sid, "symbol", F.col("date").cast("string")).alias("position_id"),
        sid.alias("strategy_id"),
        "symbol",
        F.col("date").alias("entry_date"),
        F.col("price").alias("entry"),
        "stop",
        "target",
        F.floor(F.lit(capital) / F.col("price")).alias("shares"),
        F.lit("open").alias("status"),
    )


def mark_to_market(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """positions with last_close, status (stop first, then target), exit at the level, return_pct and r_multiple."""
    joined = positions.drop("status").join(latest_close(bars), "symbol", "left")
    stopped, hit = F.col("last_close") <= F.col("stop"), F.col("last_close") >= F.col("target")
    status = F.when(stopped, "stop_hit").when(hit, "target_hit").otherwise("open")
    exit_ = F.when(stopped, F.col("stop")).when(hit, F.col("target"))
    price = F.coalesce(exit_, F.col("last_close"))
    risk = F.col("entry") - F.col("stop")
    return joined.withColumns(
        {
            "status": status,
            "exit": exit_,
            "return_pct": F.try_divide(price, F.col("entry")) - 1,
            "r_multiple": F.when(risk > 0, (price - F.col("entry")) / risk),
        }
    )


def list_positions(positions: DataFrame, strategy_id: str | None = None, status: str | None = None) -> DataFrame:
    if strategy_id is not None:
        positions = positions.filter(F.col("strategy_id") == strategy_id)
    if status is not None:
        positions = positions.filter(F.col("status") == "open" if status == "open" else F.col("status") != "open")
    return positions.orderBy(F.desc("entry_date"), "position_id")


def scoreboard(positions: DataFrame) -> DataFrame:
    """A row for each strategy ("unassigned" for none): open and closed counts, profit, win rate, mean return and R."""
    price = F.coalesce("exit", "last_close", "entry")
    closed = F.col("status") != "open"
    return positions.groupBy(F.coalesce("strategy_id", F.lit("unassigned")).alias("strategy_id")).agg(
        F.count_if(~closed).alias("n_open"),
        F.count_if(closed).alias("n_closed"),
        F.sum((price - F.col("entry")) * F.col("shares")).alias("pnl"),
        F.avg(F.when(closed, (F.col("return_pct") > 0).cast("double"))).alias("win_rate"),
        F.avg("return_pct").alias("avg_return"),
        F.avg("r_multiple").alias("avg_r"),
    )


def build_alerts(signals: DataFrame, positions: DataFrame, board: DataFrame, breach: float = -0.15) -> DataFrame:
    """kind, symbol, strategy_id, value of new and exit signals, hit levels, and strategies at or under the breach."""
    none = F.lit(None).cast("string")
    kind = F.when(F.col("action") == "buy", "new_signal").when(F.col("action") == "sell", "exit_signal")
    of_signals = signals.select(kind.alias("kind"), F.col("symbol").cast("string").alias("symbol"), none.alias("strategy_id"), F.col("price").cast("double").alias("value"))
    hits = positions.filter(F.col("status").isin("stop_hit", "target_hit"))
    of_hits = hits.select(F.col("status").alias("kind"), F.col("symbol").cast("string").alias("symbol"), F.col("strategy_id").cast("string").alias("strategy_id"), F.col("exit").alias("value"))
    low = board.filter(F.col("avg_return") <= breach)
    of_board = low.select(F.lit("drawdown_breach").alias("kind"), none.alias("symbol"), "strategy_id", F.col("avg_return").alias("value"))
    return of_signals.filter("kind is not null").unionByName(of_hits).unionByName(of_board)

"""A declarative strategy as one lazy plan: features, screen, rank, selection, weights, fills, exits, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outcomes, panel, performance, selection


@dataclass(frozen=True)
class StrategySpec:
    features: Sequence[str] = ("sma50", "roc21")
    filters: Sequence[str] = ("close > sma50",)
    rank: Sequence[tuple[str, float, str]] = (("roc21", 1.0, "desc"),)
    rank_by: str | None = "roc21"
    rebalance: str = "weekly"
    n_holdings: int = 10
    sector_cap: int | None = 2
    weighting: str = "equal"
    max_weight: float | None = None
    stop: tuple[str, float] | None = ("pct", 0.1)
    target: tuple[str, float] | None = None
    max_hold: int | None = None
    exclude_sectors: Sequence[str] = field(default_factory=tuple)


def selections(spec: StrategySpec, bars: DataFrame, sectors: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """symbol, date, score, position, weight on rebalance dates. Features see all bars; ranks only the rebalance dates."""
    wanted = [*spec.features] + (["ret_vol"] if spec.weighting == "inverse_vol" else [])
    featured = panel.with_features(bars, wanted, bench)
    days = selection.rebalance_dates(bars, spec.rebalance)
    at = panel.with_sector(featured.join(F.broadcast(days), "date", "left_semi"), sectors)
    at = panel.exclude_sectors(at, spec.exclude_sectors) if spec.exclude_sectors else at
    screened = panel.screen(at, spec.filters)
    if spec.rank_by:
        ranked = screened.filter("eligible").withColumn("score", F.col(spec.rank_by))
    else:
        ranked = selection.blend_rank(screened, spec.rank).filter("eligible")
    top = selection.select_top_n(ranked, spec.n_holdings, spec.sector_cap)
    weigh = selection.inverse_vol_weight if spec.weighting == "inverse_vol" else lambda s: selection.equal_weight(s, spec.n_holdings)
    weighted = weigh(top)
    return selection.cap_weights(weighted, spec.max_weight) if spec.max_weight else weighted


def evaluate(spec: StrategySpec, bars: DataFrame, sectors: DataFrame, capital: float = 1e6, bench: DataFrame | None = None) -> dict[str, DataFrame]:
    """selections, trades, nav and summary of a strategy as set-based outcomes."""
    chosen = selections(spec, bars, sectors, bench)
    spans = outcomes.holding_spans(chosen, bars)
    first = chosen.groupBy("symbol").agg(F.avg("weight").alias("weight"))
    opens = bars.select("symbol", F.col("date").alias("entry_date"), F.col("open").alias("price"))
    leveled = selection.stop_target(spans.join(opens, ["symbol", "entry_date"]), spec.stop, spec.target).drop("price")
    trades = outcomes.trade_outcomes(outcomes.first_touch(leveled, bars, max_hold=spec.max_hold)).join(first, "symbol")
    nav = outcomes.nav_series(trades, bars, capital).withColumn("variant", F.lit("base"))
    return {"selections": chosen, "trades": trades, "nav": nav, "summary": performance.returns_summary(nav)}

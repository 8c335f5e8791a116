"""Normalising, checking and reconciling fundamentals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.columns import positive

#: Statement lines by name of the ratio input (fixed values of the source format).
LINES = {
    "revenue": ("profit-loss", "Sales"),
    "expenses": ("profit-loss", "Expenses"),
    "op_profit": ("profit-loss", "Operating Profit"),
    "interest": ("profit-loss", "Interest"),
    "pbt": ("profit-loss", "Profit before tax"),
    "net_profit": ("profit-loss", "Net Profit"),
    "eps": ("profit-loss", "EPS in Rs"),
    "capital": ("balance-sheet", "Equity Capital"),
    "reserves": ("balance-sheet", "Reserves"),
    "borrowings": ("balance-sheet", "Borrowings"),
    "total_assets": ("balance-sheet", "Total Assets"),
    "cfo": ("cash-flow", "Cash from Operating Activity"),
}
_KEYS = ("symbol", "basis", "period_end")


def eav_pivot(eav: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("id", "date")) -> DataFrame:
    """A column for each metric: the greatest value of it for the key."""
    return eav.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def _wide(lines: DataFrame) -> DataFrame:
    pick = lambda s, k: F.max(F.when((F.col("section") == s) & (F.col("label") == k), F.col("value")))
    return lines.groupBy(*_KEYS).agg(*[pick(*v).alias(k) for k, v in LINES.items()])


def statement_ratios(lines: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """Ratios of each (symbol, basis, period_end) from statement lines (section, label, value).

    owner (symbol, basis, period_end, net_profit_owner) gives the owners' profit; without it the net profit counts.
    """
    wide = _wide(lines)
    if owner is None:
        wide = wide.withColumn("net_profit_owner", F.col("net_profit"))
    else:
        wide = wide.join(owner.select(*_KEYS, "net_profit_owner"), list(_KEYS), "left")
    has_equity = F.col("capital").isNotNull()
    equity = F.when(has_equity, F.col("capital") + F.coalesce("reserves", F.lit(0.0)))
    wide = wide.withColumn("equity", equity)
    nz = lambda c: F.nullif(F.col(c), F.lit(0.0))
    used = F.coalesce("equity", F.lit(0.0)) + F.coalesce("borrowings", F.lit(0.0))
    before = Window.partitionBy("symbol", "basis").orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last("net_profit_owner", ignorenulls=True).over(before)
    return wide.withColumns(
        {
            "tax": F.col("pbt") - F.col("net_profit"),
            "ebit": F.col("pbt") + F.col("interest"),
            "opm": F.try_divide(F.col("op_profit"), nz("revenue")) * 100,
            "npm": F.try_divide(F.col("net_profit_owner"), nz("revenue")) * 100,
            "roe": F.try_divide(F.col("net_profit_owner"), nz("equity")) * 100,
            "roce": F.when(used > 0, F.try_divide(F.col("pbt") + F.col("interest"), used) * 100),
            "de": F.try_divide(F.col("borrowings"), nz("equity")),
            "np_yoy": F.try_divide(F.col("net_profit_owner") - prior, F.nullif(F.abs(prior), F.lit(0.0))) * 100,
        }
    )


def owner_profit(stmts: DataFrame, external: DataFrame) -> DataFrame:
    """stmts with net_profit_owner: the external owners' figure of the year, else net profit times the symbol's factor.

    The factor is the upper median of owners' / net profit over years that have both, if it lies in (0.3, 1.05), else 1; symbols
    marked is_financial take 1.
    """
    ext = external.select(F.col("symbol").alias("_symbol"), F.col("year").alias("_year"), F.col("net_profit_owner").alias("_ext"))
    joined = stmts.join(ext, (F.col("symbol") == F.col("_symbol")) & (F.year("period_end") == F.col("_year")), "left")
    pairs = joined.filter("_ext is not null and net_profit is not null and net_profit <> 0")
    pairs = pairs.groupBy("symbol").agg(F.sort_array(F.collect_list(F.col("_ext") / F.col("net_profit"))).alias("_r"))
    median = F.col("_r")[F.floor(F.size("_r") / 2).cast("int")]
    factor = pairs.select("symbol", F.when((median > 0.3) & (median < 1.05), median).otherwise(1.0).alias("_factor"))
    financial = F.coalesce(F.col("is_financial"), F.lit(False)) if "is_financial" in stmts.columns else F.lit(False)
    scale = F.when(financial, F.lit(1.0)).otherwise(F.coalesce("_factor", F.lit(1.0)))
    out = joined.join(factor, "symbol", "left")
    return out.withColumn("net_profit_owner", F.coalesce("_ext", F.col("net_profit") * scale)).drop("_symbol", "_year", "_ext", "_factor")


def is_financial(df: DataFrame, terms: Sequence[str] = ("bank", "financ", "insurance", "nbfc")) -> DataFrame:
    """symbol, is_financial from lines (label) and sector text: a telling sector, or no sales line at all."""
    sector = F.lower(F.coalesce(F.max("sector"), F.lit("")))
    told = F.lit(False)
    for t in terms:
        told = told | sector.contains(t)
    no_sales = ~F.coalesce(F.bool_or(F.col("label") == "Sales"), F.lit(False))
    return df.groupBy("symbol").agg((told | no_sales).alias("is_financial"))


def confidence_tier(lines: DataFrame, external: DataFrame | None = None, financial: DataFrame | None = None) -> DataFrame:
    """symbol, identity_rate, flags, confidence: excluded-financial, quarantined, low or high.

    Years where operating profit is sales less expenses within 1.5 % make the rate. external (symbol, year, revenue, total_assets)
    flags a figure that disagrees by over 5 % in two years or more.
    """
    wide = _wide(lines)
    gap = F.abs(F.col("op_profit") - (F.col("revenue") - F.col("expenses"))) / F.greatest(
        F.abs(F.col("revenue") - F.col("expenses")), F.lit(1.0)
    )
    has = F.col("revenue").isNotNull() & F.col("expenses").isNotNull() & F.col("op_profit").isNotNull()
    ok = has & (F.col("expenses") != 0) & (gap <= 0.015)
    votes = wide.withColumn("year", F.year("period_end"))
    if external is not None:
        e = external.select("symbol", "year", F.col("revenue").alias("_revenue"), F.col("total_assets").alias("_total_assets"))
        votes = votes.join(e, ["symbol", "year"], "left")
    else:
        votes = votes.withColumns({"_revenue": F.lit(None).cast("double"), "_total_assets": F.lit(None).cast("double")})
    both = {c: F.col(c).isNotNull() & (F.col(c) != 0) & F.col(f"_{c}").isNotNull() & (F.col(f"_{c}") != 0) for c in ("revenue", "total_assets")}
    close = {c: both[c] & (F.abs(F.col(c) - F.col(f"_{c}")) / F.abs(F.col(f"_{c}")) <= 0.05) for c in both}
    sums = votes.groupBy("symbol").agg(
        F.count_if(has).alias("n"),
        F.count_if(ok).alias("k"),
        *[F.count_if(both[c]).alias(f"{c}_n") for c in both],
        *[F.count_if(close[c]).alias(f"{c}_k") for c in both],
    )
    rate = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.lit(1.0))
    flag = lambda name, n, k, when: F.when(when, F.concat(F.lit(f"{name}-"), F.col(k).cast("string"), F.lit("/"), F.col(n).cast("string")))
    off = lambda c: (F.col(f"{c}_n") > 0) & (F.col(f"{c}_k") < F.col(f"{c}_n") - 1)
    flags = F.array_compact(
        F.array(
            flag("identity", "n", "k", rate < 0.8),
            flag("ext-rev", "revenue_n", "revenue_k", off("revenue")),
            flag("ext-assets", "total_assets_n", "total_assets_k", off("total_assets")),
        )
    )
    out = sums.select("symbol", rate.alias("identity_rate"), flags.alias("flags"))
    out = out.join(financial, "symbol", "left") if financial is not None else out.withColumn("is_financial", F.lit(False))
    fin = F.coalesce("is_financial", F.lit(False))
    tier = (
        F.when(fin, F.lit("excluded-financial"))
        .when(F.col("identity_rate") < 0.5, F.lit("quarantined"))
        .when((F.col("identity_rate") < 0.8) | (F.size("flags") > 0), F.lit("low"))
        .otherwise(F.lit("high"))
    )
    flags = F.when(fin, F.array(F.lit("FIN-SCHEMA"))).otherwise(F.col("flags"))
    return out.select("symbol", "identity_rate", flags.alias("flags"), tier.alias("confidence"))


def prefer_standalone(consolidated: Column, standalone: Column, least: int = 6) -> Column:
    return (consolidated < least) & (standalone > consolidated)


def choose_basis(stmts: DataFrame, least: int = 6) -> DataFrame:
    """Rows of one basis a symbol: standalone only if it has more periods than a consolidated basis with under `least`."""
    n = lambda basis: F.countDistinct(F.when(F.col("basis") == basis, F.col("period_end")))
    counts = stmts.groupBy("symbol").agg(n("consolidated").alias("_c"), n("standalone").alias("_s"))
    pick = F.when(prefer_standalone(F.col("_c"), F.col("_s"), least), F.lit("standalone")).otherwise(F.lit("consolidated"))
    return stmts.join(counts.select("symbol", pick.alias("basis")), ["symbol", "basis"], "left_semi")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tolerances: Sequence[float] = (2, 5, 10)) -> DataFrame:
    """A row for each column: pairs, median absolute difference in percent of b, and pairs within each tolerance."""
    right = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    joined = a.join(right, list(keys))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), (F.abs(F.try_divide(F.col(c) - F.col(f"_{c}"), F.abs(F.col(f"_{c}")))) * 100).alias("diff")) for c in cols])
    )
    long = joined.select(pairs.alias("p")).select("p.*").filter("diff is not null")
    within = [f"within_{t:g}" for t in tolerances]
    counts = long.groupBy("field").agg(F.count("*").alias("n"), *[F.count_if(F.col("diff") <= t).alias(c) for c, t in zip(within, tolerances, strict=True)])
    median = exact_quantiles(long, ["field"], "diff", [0.5]).select("field", F.col("quantile").alias("median_diff"))
    return counts.join(median, "field").select("field", "n", "median_diff", *[F.col(f"`{c}`") for c in within])


def worst_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str, k: int = 10) -> DataFrame:
    """The k keys where the two sources differ most."""
    diff = F.abs(F.try_divide(F.col(col) - F.col("_b"), F.abs(F.col("_b")))) * 100
    joined = a.join(b.select(*keys, F.col(col).alias("_b")), list(keys))
    return joined.select(*keys, F.col(col).alias("a"), F.col("_b").alias("b"), diff.alias("diff")).orderBy(F.desc_nulls_last("diff"), *keys).limit(k)


def valuation_features(panel: DataFrame, snapshot: bool = True) -> DataFrame:
    """Adds pe, pb, peg, pe_to_sector from close, eps, roe, growth, sector_pe; snap_pe and snap_pb, where there, win."""
    pe = F.try_divide(F.col("close"), positive(F.col("eps")))
    pb = positive(pe * F.col("roe") / 100)
    if snapshot and "snap_pe" in panel.columns:
        pe = F.coalesce("snap_pe", pe)
    if snapshot and "snap_pb" in panel.columns:
        pb = F.coalesce("snap_pb", pb)
    panel = panel.withColumn("pe", pe).withColumn("pb", pb)
    return panel.withColumns(
        {
            "peg": F.try_divide(positive(F.col("pe")), positive(F.col("growth"))),
            "pe_to_sector": F.try_divide(F.col("pe"), F.nullif(F.col("sector_pe"), F.lit(0.0))),
        }
    )


def mapping_guard(df: DataFrame) -> DataFrame:
    """Rows whose page_symbol isn't the symbol asked for become quarantined, with a flag in front."""
    wrong = F.coalesce(F.upper("page_symbol") != F.upper("symbol"), F.lit(False))
    said = F.concat(F.lit("symbol-mismatch:"), F.col("page_symbol"))
    return df.withColumns(
        {
            "flags": F.when(wrong, F.array_insert("flags", F.lit(1), said)).otherwise(F.col("flags")),
            "confidence": F.when(wrong, F.lit("quarantined")).otherwise(F.col("confidence")),
        }
    )


def ingest_status(df: DataFrame) -> DataFrame:
    """confidence, rows, symbols, first and last period; the row of a null confidence has all together."""
    sums = [F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.min("period_end").alias("first"), F.max("period_end").alias("last")]
    whole = df.agg(*sums).select(F.lit(None).cast("string").alias("confidence"), "n_rows", "n_symbols", "first", "last")
    return df.filter("confidence is not null").groupBy("confidence").agg(*sums).unionByName(whole)

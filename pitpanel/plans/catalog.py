"""Registered queries over the reference tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.columns import canon_symbol, modulo, ratio
from ..operators import fundamentals, panel, pit
from ..sources import readers
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
C = F.col
W = "OVER (PARTITION BY symbol ORDER BY date"


def query(sql: str | None = None, recursive: bool = False):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fx.SQL.strip()}{sql if sql.startswith(',') else ' ' + sql}"
        return fn

    return register


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


# ---- A: sources -------------------------------------------------------------------------------------------------------------
@query("SELECT 'bars' AS name, count(*) AS n_rows FROM bars UNION ALL SELECT 'shares', count(*) FROM shares")
def a5_table_report(s, d):
    return readers.table_report({"bars": fx.bars(s, d), "shares": fx.shares(s, d)}).select("name", "n_rows")


@query("""SELECT s_suppkey AS symbol, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE CAST(s_nationkey AS DOUBLE) END AS x,
  CASE WHEN s_nationkey < 10 THEN s_name ELSE 'nation ' || s_nationkey END AS y FROM supplier""")
def a6_merge_column_groups(s, d):
    t = fx.table(s, d, "supplier").withColumnRenamed("s_suppkey", "symbol")
    a = t.select("symbol", F.when(C("s_acctbal") > 0, C("s_acctbal")).alias("x"))
    b = t.select("symbol", F.when(C("s_nationkey") < 10, C("s_name")).alias("y"))
    c = t.select("symbol", C("s_nationkey").cast("double").alias("x"), F.concat(F.lit("nation "), "s_nationkey").alias("y"))
    return readers.merge_column_groups([a, b, c], "symbol")


@query("""SELECT symbol, date, CASE WHEN volume > 40 THEN close * 2 ELSE close END AS close FROM bars WHERE volume > 20 OR symbol % 2 = 0""")
def a9_upsert(s, d):
    b = fx.bars(s, d)
    base = b.filter("symbol % 2 = 0 or volume > 20").select("symbol", "date", "close")
    return readers.upsert(base, b.filter("volume > 40").select("symbol", "date", (C("close") * 2).alias("close")), ["symbol", "date"])


@query("""SELECT symbol, date, close FROM bars WHERE date NOT IN (SELECT date FROM bars WHERE date < DATE '1997-01-01')""")
def a12_new_dates_only(s, d):
    b = fx.bars(s, d).select("symbol", "date", "close")
    return readers.new_dates_only(b, b.filter("date < date'1997-01-01'"))


@query(""", h AS (SELECT * FROM bars WHERE date < DATE '1999-01-01')
SELECT symbol, date, CASE WHEN date >= (SELECT max(date) - 7 FROM h) THEN close * 2 ELSE close END AS close FROM bars""")
def a12_incremental(s, d):
    b = fx.bars(s, d).select("symbol", "date", "close")
    base = b.filter("date < date'1999-01-01'")
    return readers.incremental(b.withColumn("close", C("close") * 2), base)


@query("""SELECT (SELECT count(*) FROM supplier) AS requested, count(DISTINCT symbol) AS ok, (SELECT count(*) FROM supplier) - count(DISTINCT symbol) AS failed,
  count(DISTINCT symbol) / (SELECT count(*) FROM supplier) AS coverage FROM bars WHERE close > 2500 AND volume > 150""")
def a15_load_coverage(s, d):
    asked = fx.table(s, d, "supplier").select(C("s_suppkey").alias("symbol"))
    return readers.load_coverage(asked, fx.bars(s, d).filter("close > 2500 and volume > 150"))


@query("""SELECT symbol, date, max(close) AS close, coalesce(arg_max(CASE WHEN a > 0 THEN adj_close END, close), max(close)) AS adj_close FROM (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, l_extendedprice * (1 - l_discount) AS adj_close, l_discount AS a FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_extendedprice DESC, CASE WHEN l_discount > 0 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END DESC) = 1) GROUP BY ALL""")
def a16_normalize_bars(s, d):
    li = fx.table(s, d, "lineitem")
    adj = F.when(C("l_discount") > 0, C("l_extendedprice") * (1 - C("l_discount")))
    raw = li.select(C("l_suppkey").alias("symbol"), C("l_shipdate").alias("date"), C("l_extendedprice").alias("close"), adj.alias("adj_close"))
    return readers.normalize_bars(raw)


# ---- B: panels --------------------------------------------------------------------------------------------------------------
@query("""SELECT symbol, date, round(open * (adj_close / close), 9) AS open, round(high * (adj_close / close), 9) AS high, round(low * (adj_close / close), 9) AS low, round(adj_close, 9) AS close FROM bars""")
def b1_adjust_ohlc(s, d):
    return rounded(panel.adjust_ohlc(fx.bars(s, d)).select("symbol", "date", "open", "high", "low", "close"))


@query("SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT symbol FROM sectors WHERE sector = 'ASIA') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def b2_bars_between(s, d):
    return panel.bars_between(fx.bars(s, d), fx.sectors(s, d).filter("sector = 'ASIA'"), "1996-01-01", "1997-12-31").select("symbol", "date", "close")


@query("SELECT date, round(avg(close) FILTER (symbol = 1), 9) AS s1, round(avg(close) FILTER (symbol = 2), 9) AS s2, round(avg(close) FILTER (symbol = 3), 9) AS s3 FROM bars GROUP BY date")
def b3_to_wide(s, d):
    wide = panel.to_wide(fx.bars(s, d), "close", [1, 2, 3], "avg")
    return rounded(wide.select("date", C("1").alias("s1"), C("2").alias("s2"), C("3").alias("s3")))


_GRID = """, dates AS (SELECT DISTINCT date FROM bars), spans AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol),
grid AS (SELECT symbol, date FROM spans, dates WHERE date BETWEEN a AND b),
dense AS (SELECT grid.symbol, grid.date, close FROM grid LEFT JOIN bars USING (symbol, date))"""


@query(_GRID + " SELECT symbol, date, close FROM dense")
def b4_densify(s, d):
    return panel.densify(fx.bars(s, d).select("symbol", "date", "close"), bounded=True)


@query(_GRID + f" SELECT symbol, date, last_value(close IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS close FROM dense")
def b5_ffill(s, d):
    return panel.ffill(panel.densify(fx.bars(s, d).select("symbol", "date", "close"), bounded=True), ["close"])


@query(_GRID + f" SELECT symbol, date, last_value(close IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close FROM dense")
def b6_ffill_limited(s, d):
    return panel.ffill(panel.densify(fx.bars(s, d).select("symbol", "date", "close"), bounded=True), ["close"], 2)


@query("SELECT symbol, date, coalesce(a.close, b.close) AS close FROM (SELECT * FROM bars WHERE volume > 30) a FULL JOIN (SELECT symbol, date, low AS close FROM bars WHERE volume < 40) b USING (symbol, date)")
def b7_combine_first(s, d):
    b = fx.bars(s, d)
    return panel.combine_first(b.filter("volume > 30"), b.filter("volume < 40").select("symbol", "date", C("low").alias("close")), ["symbol", "date"], ["close"])


@query("SELECT s_suppkey AS id, upper(s_name) AS symbol FROM supplier")
def b8_canon_symbol(s, d):
    return fx.table(s, d, "supplier").select(C("s_suppkey").alias("id"), canon_symbol(F.concat("s_name", F.lit(".NS"))).alias("symbol"))


@query("SELECT DISTINCT upper(s_name) AS symbol, s_suppkey AS id FROM supplier")
def b9_symbol_map(s, d):
    t = fx.table(s, d, "supplier").select(C("s_name").alias("symbol"), C("s_suppkey").alias("id"))
    return panel.symbol_map(t.filter("id % 3 <> 0"), t.filter("id % 2 = 0 or id % 3 = 0").withColumn("symbol", F.concat("symbol", F.lit(".NS"))))


@query("SELECT symbol, date, coalesce(sector, 'Unknown') AS sector FROM bars LEFT JOIN (SELECT * FROM sectors WHERE symbol % 4 > 0) USING (symbol)")
def b10_with_sector(s, d):
    return panel.with_sector(fx.bars(s, d), fx.sectors(s, d).filter("symbol % 4 > 0")).select("symbol", "date", "sector")


@query("SELECT date, 'C' || id AS symbol, round(avg(value), 4) AS value FROM eav WHERE metric = 'NP' GROUP BY ALL")
def b11_metric_panel(s, d):
    e = fx.eav(s, d)
    ids = e.select("id").distinct().withColumn("symbol", F.concat(F.lit("C"), "id"))
    return rounded(panel.metric_panel(e, "NP", ids), 4)


@query("SELECT date, 'C' || id AS symbol, round(avg(value), 4) AS value FROM eav WHERE metric = 'NP' GROUP BY ALL")
def b11_metric_panel_all(s, d):
    return b11_metric_panel(s, d)


@query("SELECT symbol, date, close FROM bars WHERE date < DATE '2000-01-01' UNION ALL SELECT symbol, date, low FROM bars WHERE date > (SELECT max(date) FROM bars WHERE date < DATE '2000-01-01')")
def b12_splice_latest(s, d):
    b = fx.bars(s, d)
    return panel.splice_latest(b.filter("date < date'2000-01-01'").select("symbol", "date", "close"), b.select("symbol", "date", C("low").alias("close")))


_LAST = ", gone AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol HAVING symbol % 5 = 0)"


@query(_LAST + """, f AS (SELECT symbol, from_date, 1 + shares / 1000 AS factor FROM shares WHERE symbol % 2 = 0)
SELECT symbol, date, close FROM bars WHERE symbol NOT IN (SELECT symbol FROM gone)
UNION ALL SELECT b.symbol, b.date, round(b.close * coalesce(f.factor, 1.0), 9) FROM (SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM gone)) b
ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.date >= f.from_date""")
def b13_adjusted_panel(s, d):
    b = fx.bars(s, d)
    gone = b.filter("symbol % 5 = 0").select("symbol").distinct()
    f = fx.shares(s, d).filter("symbol % 2 = 0").select("symbol", "from_date", (1 + C("shares") / 1000).alias("factor"))
    out = panel.adjusted_panel(b, b, f, gone)
    return out.select("symbol", "date", F.when(C("symbol") % 5 == 0, F.round("close", 9)).otherwise(C("close")).alias("close"))


@query("SELECT symbol, date, turnover AS traded FROM bars WHERE turnover > 50000 AND volume > 20")
def b14_traded_value(s, d):
    raw = fx.bars(s, d).withColumn("series", F.when((C("volume") > 20) & (C("turnover") > 50000), "EQ").otherwise("BE"))
    return panel.traded_value(raw)


@query("SELECT date, round(avg(close), 9) AS close FROM bars GROUP BY date")
def b15_benchmark_series(s, d):
    b = fx.bars(s, d)
    return rounded(panel.benchmark_series(b.select(F.lit("other").alias("name"), "date", "close"), "index", b))


@query("SELECT DISTINCT symbol FROM bars WHERE symbol % 3 = 0")
def b16_tradable(s, d):
    return panel.tradable(fx.sectors(s, d).filter("symbol % 3 = 0"), fx.bars(s, d))


# ---- C: screens -------------------------------------------------------------------------------------------------------------
_SMA = lambda c, n: f"CASE WHEN count({c}) {W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg({c}) {W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_ROC = lambda n: f"(close / nullif(lag(close, {n}) {W}), 0) - 1) * 100"


@query(f"SELECT symbol, date, coalesce(close > m AND volume > 20, false) AS eligible FROM (SELECT *, {_SMA('close', 20)} AS m FROM bars)")
def c1_screen(s, d):
    b = fx.bars(s, d).withColumn("m", ind.sma(C("close"), 20))
    return panel.screen(b, ["close > m", C("volume") > 20]).select("symbol", "date", "eligible")


@query("""SELECT symbol, date, round(volume / nullif(high - low, 0), 6) AS q, ((CAST(volume AS BIGINT) - 60) % 7 + 7) % 7 AS m, round(pow(close / 1000, 2), 6) AS p,
  (close > open) <> (volume > 30) AS x, NOT (close > open) AS n FROM bars""")
def c2_expressions(s, d):
    b = fx.bars(s, d)
    return b.select(
        "symbol", "date", F.round(ratio(C("volume"), C("high") - C("low")), 6).alias("q"), modulo(C("volume").cast("long") - 60, F.lit(7).cast("long")).alias("m"),
        F.round(F.pow(C("close") / 1000, 2), 6).alias("p"), ((C("close") > C("open")) != (C("volume") > 30)).alias("x"), (~(C("close") > C("open"))).alias("n"),
    )


@query(f"SELECT symbol, date, round({_SMA('close', 50)}, 6) AS sma50, round({_ROC(21)}, 6) AS roc21, round({_SMA('volume', 21)}, 6) AS vol_avg21, round({_SMA('(close*volume)', 21)}, 6) AS adtv21 FROM bars")
def c3_with_features(s, d):
    out = panel.with_features(fx.bars(s, d), ["sma50", "roc21", "vol_avg21", "adtv21"])
    return out.select("symbol", "date", r("sma50"), r("roc21"), r("vol_avg21"), r("adtv21"))


@query("SELECT symbol, sector FROM sectors WHERE NOT (lower(sector) LIKE '%asia%' OR lower(sector) LIKE '%amer%')")
def c4_exclude_sectors(s, d):
    return panel.exclude_sectors(fx.sectors(s, d), ["Asia", "AMER"])


@query("SELECT symbol, date, volume > 20 AND coalesce(mcap > 1000000, false) AS eligible FROM bars LEFT JOIN mcap USING (symbol, date)")
def c5_gate_membership(s, d):
    p = panel.screen(fx.bars(s, d), ["volume > 20"])
    runs = pit.membership_runs(fx.mcap(s, d), fx.bars(s, d), 1e6, limit=0)
    return panel.gate_membership(p, runs).select("symbol", "date", "eligible")


@query("SELECT symbol, date, volume > 20 AS eligible FROM bars")
def c6_skip_unknown(s, d):
    return panel.screen(fx.bars(s, d), ["volume > 20", "no_such_feature > 1"], on_unknown="skip").select("symbol", "date", "eligible")


# ---- D: indicators ----------------------------------------------------------------------------------------------------------
def _one(column, digits=6):
    return lambda s, d: fx.bars(s, d).select("symbol", "date", F.round(column(), digits).alias("v"))


def _indicator(name: str, column, sql: str, digits: int = 6) -> None:
    fn = _one(column, digits)
    fn.__name__ = name
    query(f"SELECT symbol, date, round({sql}, {digits}) AS v FROM bars")(fn)


def _roll(fn: str, c: str, n: int, least: int | None = None) -> str:
    frame = f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} >= {least or n} THEN {fn}({c}) {frame} END"


_indicator("d1_sma", lambda: ind.sma(C("close"), 20), _SMA("close", 20))
_indicator("d4_roc", lambda: ind.roc(C("close"), 21), _ROC(21))
_indicator("d6_true_range", ind.true_range, f"CASE WHEN lag(close) {W}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {W})), abs(low - lag(close) {W}))) END", 9)
_indicator("d12_rolling_high", lambda: ind.rolling_high(C("close"), 52), _roll("max", "close", 52))
_indicator("d13_rolling_low", lambda: ind.rolling_low(C("close"), 52), _roll("min", "close", 52))
_indicator("d14_dist_from_high", lambda: ind.dist_from_high(C("close"), 252), f"close / ({_roll('max', 'close', 252)}) - 1")
_indicator("d15_volume_avg", lambda: ind.volume_avg(C("volume"), 20), _roll("avg", "volume", 20))
_indicator("d16_adtv", lambda: ind.adtv(C("close"), C("volume"), 21), _roll("avg", "(close * volume)", 21))
_indicator("d17_adtv_cr", lambda: ind.adtv_cr(C("turnover")), f"({_roll('avg', 'turnover', 20, 5)}) / 1e7", 12)


@query(f""", j AS (SELECT b.*, x.close AS bc FROM bars b JOIN bench x USING (date))
SELECT symbol, date, round((close / lag(close, 63) {W})) / (bc / lag(bc, 63) {W})), 6) AS v FROM j""")
def d18_rel_strength(s, d):
    return ind.rel_strength(fx.bars(s, d), fx.bench(s, d), 63, "v").select("symbol", "date", r("v"))


@query(f""", x AS (SELECT symbol, date, close / nullif(lag(close) {W}), 0) - 1 AS ret_1 FROM bars)
SELECT symbol, date, round(ret_1, 6) AS ret_1, round({_roll('stddev_samp', 'ret_1', 20, 10)}, 6) AS ret_vol FROM x""")
def d19_ret_vol(s, d):
    return ind.ret_vol(fx.bars(s, d)).select("symbol", "date", r("ret_1"), r("ret_vol"))


def _ewm_sql(source: str, inputs: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE e over numbered rows; inputs: output -> (input, alpha). Nulls lead only."""
    step = ", ".join(
        f"CASE WHEN e.{o} IS NULL THEN n.{c} ELSE {a:.17e} * n.{c} + {1 - a:.17e} * e.{o} END" for o, (c, a) in inputs.items()
    )
    return f""", n AS MATERIALIZED (SELECT *, row_number() {W}) AS i FROM ({source})),
e AS (SELECT symbol, i, date, {", ".join(f"CAST({c} AS DOUBLE) AS {o}" for o, (c, _) in inputs.items())} FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, n.date, {step} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query(_ewm_sql("SELECT symbol, date, close FROM brands", {"m": ("close", 2 / 21)}) + " SELECT symbol, date, CASE WHEN i >= 20 THEN round(m, 6) END AS ema20 FROM e", True)
def d3_ema(s, d):
    return ind.ema(fx.brand_bars(s, d), "close", 20).select("symbol", "date", r("ema20"))


@query(_ewm_sql("SELECT symbol, date, close FROM brands", {"m": ("close", 0.94)}) + " SELECT symbol, date, round(m, 6) AS v FROM e", True)
def d2_ewm(s, d):
    return ind.ewm(fx.brand_bars(s, d), {"v": "close"}, 0.94).select("symbol", "date", r("v"))


@query(
    _ewm_sql(
        f"SELECT symbol, date, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS down FROM (SELECT symbol, date, close, lag(close) {W}) AS pc FROM brands)",
        {"g": ("up", 1 / 14), "l": ("down", 1 / 14)},
    )
    + " SELECT symbol, date, CASE WHEN i < 15 THEN NULL WHEN l = 0 AND g > 0 THEN 100 ELSE round(100 - 100 / (1 + g / nullif(l, 0)), 6) END AS rsi14 FROM e",
    True,
)
def d5_rsi(s, d):
    return ind.rsi(fx.brand_bars(s, d)).select("symbol", "date", r("rsi14"))


_TR = "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"
_PREV = f"(SELECT *, lag(close) {W}) AS pc, lag(high) {W}) AS ph, lag(low) {W}) AS pl FROM brands)"


@query(_ewm_sql(f"SELECT symbol, date, {_TR} AS tr FROM {_PREV}", {"a": ("tr", 1 / 14)}) + " SELECT symbol, date, CASE WHEN i >= 15 THEN round(a, 6) END AS atr14 FROM e", True)
def d7_atr(s, d):
    return ind.atr(fx.brand_bars(s, d)).select("symbol", "date", r("atr14"))


_DM = f"""SELECT symbol, date, {_TR} AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS up,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS down FROM {_PREV}"""


@query(
    _ewm_sql(_DM, {"a": ("tr", 1 / 14), "p": ("up", 1 / 14), "q": ("down", 1 / 14)})
    + """, x AS (SELECT symbol, date, i, CASE WHEN i >= 15 THEN 100 * abs(100 * p / a - 100 * q / a) / nullif(100 * p / a + 100 * q / a, 0) END AS dx FROM e),
n2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS j FROM x WHERE dx IS NOT NULL),
e2 AS (SELECT symbol, j, date, dx AS v FROM n2 WHERE j = 1
  UNION ALL SELECT n2.symbol, n2.j, n2.date, n2.dx / 14 + e2.v * (1 - 1.0e0 / 14) FROM e2 JOIN n2 ON n2.symbol = e2.symbol AND n2.j = e2.j + 1)
SELECT e.symbol, e.date, CASE WHEN j >= 14 THEN round(v, 5) END AS adx14 FROM e LEFT JOIN e2 USING (symbol, date)""",
    True,
)
def d8_adx(s, d):
    return ind.adx(fx.brand_bars(s, d)).select("symbol", "date", r("adx14", 5))


@query(
    _ewm_sql("SELECT symbol, date, close FROM brands", {"f": ("close", 2 / 13), "g": ("close", 2 / 27)})
    + """, n2 AS MATERIALIZED (SELECT symbol, date, f - g AS line, row_number() OVER (PARTITION BY symbol ORDER BY date) AS j FROM e WHERE i >= 26),
e2 AS (SELECT symbol, j, date, line, line AS v FROM n2 WHERE j = 1
  UNION ALL SELECT n2.symbol, n2.j, n2.date, n2.line, 0.2 * n2.line + 0.8 * e2.v FROM e2 JOIN n2 ON n2.symbol = e2.symbol AND n2.j = e2.j + 1)
SELECT e.symbol, e.date, round(line, 5) AS macd, CASE WHEN j >= 9 THEN round(v, 5) END AS macd_signal, CASE WHEN j >= 9 THEN round(line - v, 5) END AS macd_hist
FROM e LEFT JOIN e2 USING (symbol, date)""",
    True,
)
def d9_d10_d11_macd(s, d):
    return ind.macd(fx.brand_bars(s, d)).select("symbol", "date", r("macd", 5), r("macd_signal", 5), r("macd_hist", 5))


# ---- E: point in time -------------------------------------------------------------------------------------------------------
@query("SELECT b.symbol, b.date, b.close, s.shares FROM bars b ASOF JOIN shares s ON b.symbol = s.symbol AND b.date >= s.from_date")
def e1_asof_join(s, d):
    b = fx.bars(s, d).select("symbol", "date", "close")
    return pit.asof_join(b, fx.shares(s, d), "symbol", "date", "from_date", "inner").drop("from_date")


@query("SELECT b.symbol, b.date, coalesce(s.shares, 1.0) AS shares FROM bars b ASOF LEFT JOIN (SELECT * FROM shares WHERE from_date >= DATE '1997-01-01') s ON b.symbol = s.symbol AND b.date >= s.from_date")
def e2_asof_default(s, d):
    late = fx.shares(s, d).filter("from_date >= date'1997-01-01'")
    return pit.asof_join(fx.bars(s, d).select("symbol", "date"), late, "symbol", "date", "from_date", defaults={"shares": 1.0}).drop("from_date")


@query("""SELECT p.symbol, p.date, round(q.np / q.eps * 100, 4) AS roa FROM (SELECT id AS symbol, date FROM ann) p
ASOF LEFT JOIN (SELECT id, date + 120 AS known, np, eps FROM quarters WHERE eps < 3) q ON p.symbol = q.id AND p.date >= q.known""")
def e3_pit_lagged(s, d):
    wide = fundamentals.eav_pivot(fx.eav(s, d), ["NP", "EPS"])
    fund = wide.select(C("id").alias("symbol"), C("date").alias("period_end"), C("NP").alias("net_profit_owner"), C("EPS").alias("total_assets"), F.when(C("EPS") < 3, "high").otherwise("quarantined").alias("confidence"))
    p = fx.announcements(s, d).withColumnRenamed("id", "symbol")
    return pit.pit_lagged(fund, p, ["roa"]).select("symbol", "date", r("roa", 4))


_LAG = """, first AS (SELECT p.id, p.date AS period_end, min(a.date) AS said FROM (SELECT DISTINCT id, date FROM eav) p
  LEFT JOIN ann a ON a.id = p.id AND a.date > p.date AND a.date <= p.date + 100 GROUP BY ALL),
lag_ AS (SELECT id, period_end, coalesce(said, period_end + 45) AS available_from, said IS NOT NULL AS matched,
  coalesce(said, period_end + 45) - period_end AS lag_days FROM first)"""


def _lag(s, d):
    periods = fx.eav(s, d).select("id", C("date").alias("period_end")).distinct()
    return pit.result_lag(periods, fx.announcements(s, d))


@query(_LAG + " SELECT id, period_end, available_from, matched, CAST(lag_days AS INTEGER) AS lag_days FROM lag_")
def e4_result_lag(s, d):
    return _lag(s, d)


@query(_LAG + """, k AS (SELECT l.id, available_from, arg_max(np, l.period_end) AS value FROM lag_ l JOIN quarters q ON q.id = l.id AND q.date = l.period_end GROUP BY ALL)
SELECT a.id, a.date, round(k.value, 4) AS value FROM ann a ASOF LEFT JOIN k ON a.id = k.id AND a.date >= k.available_from""")
def e5_pit_announced(s, d):
    return pit.pit_announced(fx.eav(s, d), _lag(s, d), fx.announcements(s, d), "NP").select("id", "date", r("value", 4))


@query("SELECT a.id AS symbol, a.date, round(q.np, 4) AS np FROM ann a ASOF LEFT JOIN quarters q ON a.id = q.id AND a.date >= q.date")
def e6_pit_snapshot(s, d):
    snap = fundamentals.eav_pivot(fx.eav(s, d), ["NP"]).select(C("id").alias("symbol"), C("date").alias("snapshot_date"), C("NP").alias("np"))
    return pit.pit_snapshot(snap, fx.announcements(s, d).withColumnRenamed("id", "symbol"), ["np"]).select("symbol", "date", r("np", 4))


@query("SELECT symbol, round(arg_max(mcap, date), 4) AS mcap FROM mcap WHERE date BETWEEN DATE '1998-06-30' - 14 AND DATE '1998-06-30' GROUP BY symbol HAVING arg_max(mcap, date) > 1000000")
def e7_pit_universe(s, d):
    return rounded(pit.pit_universe(fx.mcap(s, d), "1998-06-30", 1e6), 4)


@query(""", dates AS (SELECT DISTINCT date FROM bars), grid AS (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM mcap), dates),
f AS (SELECT symbol, date, last_value(mcap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS m FROM grid LEFT JOIN mcap USING (symbol, date))
SELECT symbol, date, coalesce(m > 1000000, false) AS member FROM f""")
def e8_membership_panel(s, d):
    return pit.membership_panel(fx.mcap(s, d), fx.bars(s, d).select("date"), 1e6)


@query("SELECT symbol, round(max(mcap), 4) AS peak FROM mcap WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY symbol HAVING max(mcap) > 2000000")
def e9_universe_over_window(s, d):
    return rounded(pit.universe_over_window(fx.mcap(s, d), "1997-01-01", "1998-12-31", 2e6), 4)


@query("""SELECT symbol, string_agg(f, ';' ORDER BY f) AS flags FROM (SELECT DISTINCT symbol, list_type || ' ' || stage AS f FROM surv WHERE fetch_date = (SELECT max(fetch_date) FROM surv)) GROUP BY symbol""")
def e10_latest_flags(s, d):
    text = F.array_join(F.array_sort(F.transform("flags", lambda f: F.concat_ws(" ", f["list_type"], f["stage"]))), ";")
    return pit.latest_flags(fx.surveillance(s, d)).select("symbol", text.alias("flags"))


@query("SELECT symbol, max(date) AS last_date, arg_max(coalesce(adj_close, close), date) AS last_close FROM bars GROUP BY symbol")
def e11_latest_close(s, d):
    return pit.latest_close(fx.bars(s, d))


def queries() -> dict[str, Query]:
    from . import catalog_more, catalog_sources  # noqa: F401  register the rest

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from . import catalog_more, catalog_sources  # noqa: F401

    return dict(ORACLES)

"""Registered queries over actions, fundamentals, selection, outcomes, performance, the book and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.columns import clean_date, clean_number, period_end
from ..operators import actions, audit, book, fundamentals, outcomes, panel, performance, pit, selection
from ..sources import readers
from . import fixtures as fx
from .catalog import ORACLES, QUERIES, _LAG, _ROC, _SMA, W, C, _lag, _roll, query, r, rounded
from .strategy import StrategySpec, selections

# ---- F: corporate actions ---------------------------------------------------------------------------------------------------
_GAPS = f", g AS (SELECT * FROM (SELECT symbol, date, lag(close) {W}) / close AS ratio FROM bars WHERE close > 0) WHERE ratio > 1.18 OR ratio < 0.84)"
_CANON = "[1.25, 1.33, 1.5, 1.67, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 10.0, 11.0]"


def _snap(g: str, tol: float) -> str:
    size = f"CASE WHEN {g} < 1 THEN 1.0 / {g} ELSE {g} END"
    best = f"list_min([CAST(row(abs({size} - c) / c, c) AS ROW(e DOUBLE, c DOUBLE)) FOR c IN {_CANON}])"
    return f"CASE WHEN {best}.e < {tol} THEN CASE WHEN {g} < 1 THEN 1 / {best}.c ELSE {best}.c END END"


_STEPS = f""", f AS (SELECT symbol, from_date AS date, shares / lag(shares) OVER (PARTITION BY symbol ORDER BY from_date) AS q FROM shares WHERE shares > 0),
st AS (SELECT * FROM (SELECT symbol, date, {_snap('q', 0.10)} AS step FROM f WHERE q > 1.4 OR q < 0.72) WHERE step IS NOT NULL)"""
_EVENTS = _GAPS + _STEPS + f""", c AS (SELECT * FROM (SELECT symbol, date AS ex_date, {_snap('ratio', 0.08)} AS ratio FROM g) WHERE ratio IS NOT NULL),
ev AS (SELECT c.symbol, ex_date, any_value(ratio) AS ratio, arg_min(st.date, row(abs(st.date - ex_date), st.date)) AS step_date
  FROM c JOIN st ON c.symbol = st.symbol AND abs(st.date - ex_date) <= 380 AND abs(step / ratio - 1) <= 0.08 GROUP BY c.symbol, ex_date)"""


def _shares(s, d):
    return fx.shares(s, d).withColumnRenamed("from_date", "date")


def _events(s, d):
    return actions.confirm_actions(actions.gap_candidates(fx.bars(s, d)), actions.share_steps(_shares(s, d)))


@query(_GAPS + " SELECT symbol, date, round(ratio, 6) AS ratio FROM g")
def f1_gap_candidates(s, d):
    return rounded(actions.gap_candidates(fx.bars(s, d)), 6)


@query(_GAPS + f" SELECT symbol, date, round({_snap('ratio', 0.08)}, 6) AS snapped FROM g")
def f2_snap_ratio(s, d):
    return actions.gap_candidates(fx.bars(s, d)).select("symbol", "date", F.round(actions.snap_ratio(C("ratio"), 0.08), 6).alias("snapped"))


@query(_STEPS + " SELECT symbol, date, round(step, 6) AS step FROM st")
def f3_share_steps(s, d):
    return rounded(actions.share_steps(_shares(s, d)), 6)


@query("""SELECT id AS symbol, date, round(np / eps, 4) AS shares, 'np_eps' AS source FROM quarters WHERE eps > 0
UNION ALL SELECT id, date, round(np * 0.9 / eps, 4), 'owner_eps' FROM quarters WHERE eps > 0""")
def f4_share_proxies(s, d):
    e = fx.eav(s, d)
    wide = fundamentals.eav_pivot(e, ["NP", "EPS"])
    hist = wide.select("id", C("date").alias("period_end"), (C("NP") * 0.9).alias("net_profit_owner"), C("EPS").alias("eps"))
    return rounded(actions.share_proxies(e, hist), 4)


@query(_EVENTS + " SELECT symbol, ex_date, round(ratio, 6) AS ratio, step_date FROM ev")
def f5_confirm_actions(s, d):
    return rounded(_events(s, d), 6)


_YEARLY = """, y AS (SELECT symbol, ex_date, ratio FROM (SELECT DISTINCT symbol, CAST(date_trunc('year', date) AS DATE) AS ex_date,
  CASE WHEN symbol % 2 = 0 THEN 2.0 ELSE 1.5 END AS ratio FROM bars WHERE date > DATE '1997-01-01')),
a AS (SELECT symbol, ex_date, product(ratio) OVER (PARTITION BY symbol ORDER BY ex_date ROWS UNBOUNDED PRECEDING) AS q, product(ratio) OVER (PARTITION BY symbol) AS t FROM y)"""


@query(_YEARLY + """ SELECT symbol, ex_date AS from_date, round(q / t, 9) AS factor FROM a
UNION ALL SELECT symbol, (SELECT min(date) FROM bars b WHERE b.symbol = z.symbol), round(1 / t, 9) FROM (SELECT symbol, max(t) AS t FROM a GROUP BY symbol) z""")
def f6_adjustment_factors(s, d):
    b = fx.bars(s, d)
    year = F.to_date(F.date_trunc("year", "date"))
    ev = b.filter("date > date'1997-01-01'").select("symbol", year.alias("ex_date"), F.when(C("symbol") % 2 == 0, 2.0).otherwise(1.5).alias("ratio")).distinct()
    return rounded(actions.adjustment_factors(ev, b.groupBy("symbol").agg(F.min("date").alias("first_date"))))


@query(_EVENTS + """ SELECT b.symbol, max(b.date) AS last_date, arg_max(b.close, b.date) AS last_close, round(any_value(p.peak), 4) AS peak_mcap,
  b.symbol IN (SELECT symbol FROM g WHERE ratio > 1.35 OR ratio < 1 / 1.35) AND b.symbol NOT IN (SELECT symbol FROM ev) AS ca_uncertain
FROM bars b LEFT JOIN (SELECT symbol, max(mcap) AS peak FROM mcap GROUP BY symbol) p ON p.symbol = b.symbol WHERE b.symbol % 5 = 0 GROUP BY b.symbol""")
def f7_delistings(s, d):
    # only dead symbols ask for gaps, events and values
    b, dead = fx.bars(s, d), "symbol % 5 = 0"
    gaps = actions.gap_candidates(b.filter(dead))
    events = actions.confirm_actions(gaps, actions.share_steps(_shares(s, d).filter(dead)))
    out = actions.delistings(b, b.filter(dead), events, gaps, fx.mcap(s, d).filter(dead))
    return out.withColumn("peak_mcap", F.round("peak_mcap", 4))


# Rounds of mutually nearest pairs, each over what the rounds before have left.
_MUTUAL = "SELECT symbol, d, td, a FROM (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY a, d, td) AS x, row_number() OVER (PARTITION BY symbol, td ORDER BY a, d, td) AS y FROM {m}) WHERE x = 1 AND y = 1"
_LEFT = "SELECT * FROM {m} WHERE NOT EXISTS (SELECT 1 FROM {r} WHERE {r}.symbol = {m}.symbol AND ({r}.d = {m}.d OR {r}.td = {m}.td))"
_ROUNDS = "".join(f"r{i} AS ({_MUTUAL.format(m=m)}),\nm{i} AS ({_LEFT.format(m=m, r=f'r{i}')}),\n" for i, m in ((1, "m"), (2, "m1"), (3, "m2"), (4, "m3")))


@query(_GAPS + """, p AS (SELECT * FROM g WHERE symbol % 2 = 0 AND ratio > 3), t AS (SELECT symbol, date + CAST(symbol % 3 AS INTEGER) AS date, ratio FROM g WHERE ratio > 4),
m AS (SELECT p.symbol, p.date AS d, t.date AS td, abs(t.date - p.date) AS a FROM p JOIN t ON p.symbol = t.symbol AND abs(t.date - p.date) <= 3 AND abs(p.ratio / t.ratio - 1) <= 0.1),
""" + _ROUNDS + """k AS (SELECT (SELECT count(*) FROM r1) + (SELECT count(*) FROM r2) + (SELECT count(*) FROM r3) + (SELECT count(*) FROM r4) AS tp)
SELECT tp, (SELECT count(*) FROM p) - tp AS fp, (SELECT count(*) FROM t) - tp AS fn, round(tp / (SELECT count(*) FROM p), 6) AS precision, round(tp / (SELECT count(*) FROM t), 6) AS recall FROM k""")
def f8_match_events(s, d):
    g = actions.gap_candidates(fx.bars(s, d))
    truth = g.filter("ratio > 4").withColumn("date", F.date_add("date", (C("symbol") % 3).cast("int")))
    return rounded(actions.match_events(g.filter("symbol % 2 = 0 and ratio > 3"), truth), 6)


@query("SELECT DISTINCT id AS symbol, date, round(np / eps, 4) AS shares FROM quarters")
def f9_shares_history(s, d):
    e = fx.eav(s, d)
    # the two tables overlap and are summed apart from each other, in whatever order rows arrive
    return rounded(actions.shares_history(e.filter("id % 2 = 0 or id % 3 = 0"), e.filter("id % 2 = 1"), digits=6), 4)


@query("SELECT symbol, date, round(mcap, 7) AS mcap FROM mcap")
def f10a_pit_mcap_asof(s, d):
    return rounded(fx.mcap(s, d), 7)


@query("SELECT symbol, date, round(close * q, 7) AS mcap FROM bars JOIN (SELECT symbol, arg_max(shares, from_date) AS q FROM shares GROUP BY symbol) USING (symbol)")
def f10b_pit_mcap(s, d):
    return rounded(actions.pit_mcap(fx.bars(s, d), _shares(s, d)), 7)


@query("SELECT symbol, date, round(mcap, 7) AS mcap, CASE WHEN symbol % 5 = 0 THEN 'dead' ELSE 'live' END AS source FROM mcap")
def f11_membership(s, d):
    m = fx.mcap(s, d)
    return rounded(actions.membership(m.filter("symbol % 5 <> 0"), m.filter("symbol % 5 = 0")), 7)


_ISIN = ", z AS (SELECT *, CASE WHEN date < DATE '1998-01-01' THEN 'old' ELSE 'new' END || symbol AS sym, 'I' || symbol AS isin FROM bars WHERE NOT (symbol % 3 = 0 AND date >= DATE '1998-01-01'))"


@query(_ISIN + """, sp AS (SELECT sym, isin, max(date) AS last_date, max(close * volume) AS peak FROM z GROUP BY ALL),
cu AS (SELECT isin, arg_max(sym, row(last_date, sym)) AS now_, max(last_date) AS alive FROM sp GROUP BY isin)
SELECT sym AS symbol, isin, last_date, CASE WHEN alive >= DATE '1999-01-01' AND now_ <> sym THEN 'renamed' ELSE 'dead' END AS status,
  CASE WHEN alive >= DATE '1999-01-01' AND now_ <> sym THEN now_ END AS renamed_to FROM sp JOIN cu USING (isin) WHERE last_date < DATE '1999-01-01' AND peak > 50000 AND sym NOT LIKE '%7'""")
def f12_classify_ended(s, d):
    b = fx.bars(s, d).filter("not (symbol % 3 = 0 and date >= date'1998-01-01')")
    name = F.concat(F.when(C("date") < F.lit("1998-01-01").cast("date"), "old").otherwise("new"), C("symbol").cast("string"))
    named = b.withColumn("isin", F.concat(F.lit("I"), C("symbol").cast("string"))).withColumn("symbol", name)
    return actions.classify_ended(named, named.filter("symbol like '%7'"), "1999-01-01", 50000)


@query("""SELECT symbol, round(max(greatest(q, 1 / q)), 6) AS max_step FROM (SELECT symbol, m / lag(m) OVER (PARTITION BY symbol ORDER BY mo) AS q FROM (
  SELECT symbol, date_trunc('month', date) AS mo, arg_max(mcap, date) AS m FROM mcap GROUP BY ALL)) WHERE q > 0 GROUP BY symbol""")
def f13_max_step(s, d):
    return rounded(actions.max_step(fx.mcap(s, d)), 6)


@query("""SELECT "asof", source, count(*) AS n FROM (SELECT a."asof", CASE WHEN symbol % 5 = 0 THEN 'dead' ELSE 'live' END AS source, symbol, arg_max(mcap, date) AS m
  FROM mcap JOIN (SELECT unnest([DATE '1997-03-31', DATE '1999-03-31']) AS "asof") a ON date <= "asof" AND date >= "asof" - 14 GROUP BY ALL) WHERE m > 1000000 GROUP BY ALL""")
def f14_membership_counts(s, d):
    m = fx.mcap(s, d)
    both = actions.membership(m.filter("symbol % 5 <> 0"), m.filter("symbol % 5 = 0"))
    dates = s.range(1).select(F.explode(F.array(F.lit("1997-03-31").cast("date"), F.lit("1999-03-31").cast("date"))).alias("date"))
    return actions.membership_counts(both, dates, 1e6)


# ---- G: fundamentals --------------------------------------------------------------------------------------------------------
_STATEMENTS = """, sq AS (SELECT id AS symbol, 'consolidated' AS basis, date AS period_end, np AS sales, np * 0.6 AS expenses,
  CASE WHEN id % 4 = 0 THEN np * 0.1 ELSE np * 0.4 END AS op, eps * 10 AS interest, np * 0.3 AS pbt, np * 0.2 AS net, CASE WHEN id % 3 > 0 THEN eps * 1000 - 2000 END AS capital,
  CASE WHEN id % 5 > 0 THEN eps * 100 END AS reserves, 1500 - eps * 500 AS borrowings FROM quarters)"""


def _lines(s, d):
    w = fundamentals.eav_pivot(fx.eav(s, d), ["NP", "EPS"])
    np_, eps, sym = C("NP"), C("EPS"), C("id")
    values = {
        ("profit-loss", "Sales"): np_, ("profit-loss", "Expenses"): np_ * 0.6, ("profit-loss", "Operating Profit"): F.when(sym % 4 == 0, np_ * 0.1).otherwise(np_ * 0.4),
        ("profit-loss", "Interest"): eps * 10, ("profit-loss", "Profit before tax"): np_ * 0.3, ("profit-loss", "Net Profit"): np_ * 0.2,
        ("balance-sheet", "Equity Capital"): F.when(sym % 3 > 0, eps * 1000 - 2000), ("balance-sheet", "Reserves"): F.when(sym % 5 > 0, eps * 100),
        ("balance-sheet", "Borrowings"): 1500 - eps * 500,
    }
    lines = F.explode(F.array(*[F.struct(F.lit(a).alias("section"), F.lit(b).alias("label"), v.alias("value")) for (a, b), v in values.items()]))
    return w.select(sym.alias("symbol"), F.lit("consolidated").alias("basis"), C("date").alias("period_end"), lines.alias("x")).select("symbol", "basis", "period_end", "x.*")


@query(_STATEMENTS + """, q AS (SELECT *, CASE WHEN capital IS NOT NULL THEN capital + coalesce(reserves, 0) END AS equity,
  last_value(net IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM sq)
SELECT symbol, period_end, round(pbt - net, 4) AS tax, round(pbt + interest, 4) AS ebit, round(op / nullif(sales, 0) * 100, 6) AS opm, round(net / nullif(sales, 0) * 100, 6) AS npm,
  round(net / nullif(equity, 0) * 100, 6) AS roe, CASE WHEN coalesce(equity, 0) + coalesce(borrowings, 0) > 0 THEN round((pbt + interest) / (coalesce(equity, 0) + coalesce(borrowings, 0)) * 100, 6) END AS roce,
  round(borrowings / nullif(equity, 0), 6) AS de, round((net - prior) / nullif(abs(prior), 0) * 100, 6) AS np_yoy FROM q""")
def g1_statement_ratios(s, d):
    out = fundamentals.statement_ratios(_lines(s, d))
    return out.select("symbol", "period_end", r("tax", 4), r("ebit", 4), r("opm"), r("npm"), r("roe"), r("roce"), r("de"), r("np_yoy"))


@query(""", y AS (SELECT id AS symbol, date AS period_end, np AS net, CASE WHEN date < DATE '1998-01-01' THEN np * (0.5 + (id % 7) / 10.0) END AS ext FROM quarters),
x AS (SELECT symbol, year(period_end) AS yr, max(ext) AS ext FROM y WHERE ext IS NOT NULL GROUP BY ALL),
p AS (SELECT y.symbol, y.period_end, y.net, x.ext FROM y LEFT JOIN x ON x.symbol = y.symbol AND x.yr = year(y.period_end)),
f AS (SELECT symbol, list_sort(list(ext / net))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS f FROM p WHERE ext IS NOT NULL AND net IS NOT NULL AND net <> 0 GROUP BY symbol)
SELECT p.symbol, p.period_end, round(coalesce(p.ext, p.net * coalesce(CASE WHEN f > 0.3 AND f < 1.05 THEN f ELSE 1.0 END, 1.0)), 4) AS net_profit_owner FROM p LEFT JOIN f USING (symbol)""")
def g2_owner_profit(s, d):
    w = fundamentals.eav_pivot(fx.eav(s, d), ["NP"]).select(C("id").alias("symbol"), C("date").alias("period_end"), C("NP").alias("net_profit"))
    early = w.filter("period_end < date'1998-01-01'")
    ext = early.groupBy("symbol", F.year("period_end").alias("year")).agg(F.max(C("net_profit") * (0.5 + (C("symbol") % 7) / 10.0)).alias("net_profit_owner"))
    return fundamentals.owner_profit(w, ext).select("symbol", "period_end", r("net_profit_owner", 4))


@query(_STATEMENTS + """ SELECT symbol, round(avg(CASE WHEN abs(op - (sales - expenses)) / greatest(abs(sales - expenses), 1) <= 0.015 THEN 1.0 ELSE 0.0 END), 6) AS identity_rate,
  CASE WHEN symbol % 4 = 0 THEN 'quarantined' ELSE 'high' END AS confidence, CASE WHEN symbol % 4 = 0 THEN 'identity-0/' || count(*) ELSE '' END AS flags FROM sq GROUP BY symbol""")
def g3_confidence_tier(s, d):
    out = fundamentals.confidence_tier(_lines(s, d))
    return out.select("symbol", r("identity_rate"), "confidence", F.array_join("flags", ",").alias("flags"))


@query("""SELECT id AS symbol, CASE WHEN c < 6 AND t > c THEN 'standalone' ELSE 'consolidated' END AS basis, CASE WHEN c < 6 AND t > c THEN t ELSE c END AS n FROM (
  SELECT id, count(*) FILTER (date >= DATE '1998-01-01') AS c, count(*) AS t FROM quarters GROUP BY id) WHERE CASE WHEN c < 6 AND t > c THEN t ELSE c END > 0""")
def g4_choose_basis(s, d):
    w = fundamentals.eav_pivot(fx.eav(s, d), ["NP"]).select(C("id").alias("symbol"), C("date").alias("period_end"))
    both = w.withColumn("basis", F.lit("standalone")).unionByName(w.filter("period_end >= date'1998-01-01'").withColumn("basis", F.lit("consolidated")))
    return fundamentals.choose_basis(both).groupBy("symbol", "basis").agg(F.count("*").alias("n"))


@query("SELECT symbol, sector = 'ASIA' OR symbol % 7 = 0 AS is_financial FROM sectors")
def g5_is_financial(s, d):
    sec = fx.sectors(s, d).withColumn("sector", F.when(C("sector") == "ASIA", "Asia Banking").otherwise(C("sector")))
    return fundamentals.is_financial(sec.withColumn("label", F.when(C("symbol") % 7 == 0, "Deposits").otherwise("Sales")))


@query("""SELECT 'np' AS field, count(*) AS n, round(median(x), 6) AS median_diff, count(*) FILTER (x <= 2) AS within_2, count(*) FILTER (x <= 5) AS within_5, count(*) FILTER (x <= 10) AS within_10
FROM (SELECT abs((np - np * (1 + (id % 13) / 100.0)) / abs(np * (1 + (id % 13) / 100.0))) * 100 AS x FROM quarters)""")
def g6_reconcile(s, d):
    a = fundamentals.eav_pivot(fx.eav(s, d), ["NP"]).withColumnRenamed("NP", "np")
    b = a.withColumn("np", C("np") * (1 + (C("id") % 13) / 100.0))
    return rounded(fundamentals.reconcile(a, b, ["id", "date"], ["np"], (2, 5.5, 10.5)).withColumnsRenamed({"within_5.5": "within_5", "within_10.5": "within_10"}), 6)


@query("""SELECT symbol, date, round(pe, 9) AS pe, round(CASE WHEN pe * roe / 100 > 0 THEN pe * roe / 100 END, 9) AS pb, round(CASE WHEN pe > 0 THEN pe END / CASE WHEN g > 0 THEN g END, 9) AS peg,
  round(pe / nullif(sp, 0), 9) AS pe_to_sector FROM (SELECT symbol, date, close / CASE WHEN volume - 10 > 0 THEN volume - 10 END AS pe, volume - 25 AS roe, volume - 20 AS g, CAST(symbol % 3 AS DOUBLE) * 10 AS sp FROM bars)""")
def g7_valuation_features(s, d):
    p = fx.bars(s, d).select("symbol", "date", "close", (C("volume") - 10).alias("eps"), (C("volume") - 25).alias("roe"), (C("volume") - 20).alias("growth"), ((C("symbol") % 3) * 10.0).alias("sector_pe"))
    return fundamentals.valuation_features(p).select("symbol", "date", r("pe", 9), r("pb", 9), r("peg", 9), r("pe_to_sector", 9))


@query("SELECT id, date, round(np, 4) AS NP, eps AS EPS FROM quarters")
def g8_eav_pivot(s, d):
    return fundamentals.eav_pivot(fx.eav(s, d), ["NP", "EPS"]).withColumn("NP", F.round("NP", 4))


@query("SELECT symbol, CASE WHEN symbol % 6 = 0 THEN 'quarantined' ELSE 'high' END AS confidence, CASE WHEN symbol % 6 = 0 THEN 'symbol-mismatch:X,seen' ELSE 'seen' END AS flags FROM sectors")
def g9_mapping_guard(s, d):
    sec = fx.sectors(s, d).withColumn("page_symbol", F.when(C("symbol") % 6 == 0, "X").otherwise(C("symbol").cast("string")))
    sec = sec.withColumn("symbol", C("symbol").cast("string")).withColumn("flags", F.array(F.lit("seen"))).withColumn("confidence", F.lit("high"))
    return fundamentals.mapping_guard(sec).select(C("symbol").cast("long").alias("symbol"), "confidence", F.array_join("flags", ",").alias("flags"))


@query("""SELECT CASE WHEN id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, count(*) AS n_rows, count(DISTINCT id) AS n_symbols, min(date) AS first, max(date) AS last FROM quarters GROUP BY 1
UNION ALL SELECT NULL, count(*), count(DISTINCT id), min(date), max(date) FROM quarters""")
def g10_ingest_status(s, d):
    w = fundamentals.eav_pivot(fx.eav(s, d), ["NP"])
    return fundamentals.ingest_status(w.select(C("id").alias("symbol"), C("date").alias("period_end"), F.when(C("id") % 2 == 0, "high").otherwise("low").alias("confidence")))


# ---- H: selection -----------------------------------------------------------------------------------------------------------
_WEEKS = ", weeks AS (SELECT min(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('week', date))"
_PANEL = _WEEKS + f""", feat AS (SELECT symbol, date, close, open, volume, {_SMA('close', 50)} AS sma50, {_ROC(21)} AS roc21 FROM bars),
pan AS (SELECT feat.*, coalesce(close > sma50, false) AS eligible, coalesce(sector, 'Unknown') AS sector FROM feat JOIN weeks USING (date) LEFT JOIN sectors USING (symbol))"""
_PCT = "(rank() OVER (PARTITION BY date ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY date, {v}) - 1) / 2.0) / count({v}) OVER (PARTITION BY date)"
_TOP = _PANEL + """, k AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY roc21 DESC, symbol DESC) AS sr FROM pan WHERE eligible AND roc21 IS NOT NULL),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY roc21 DESC, symbol DESC) AS position FROM k WHERE sr <= 2) WHERE position <= 10)"""


def _panel(s, d):
    p = panel.with_features(fx.bars(s, d), ["sma50", "roc21"])
    p = p.join(F.broadcast(selection.rebalance_dates(fx.bars(s, d), "weekly")), "date", "left_semi")
    return panel.screen(panel.with_sector(p, fx.sectors(s, d)), ["close > sma50"])


def _selected(s, d):
    return selections(StrategySpec(), fx.bars(s, d), fx.sectors(s, d))


@query(_TOP + " SELECT symbol, date, sector, position, round(roc21, 6) AS score, 0.1 AS weight FROM sel")
def flagship_weekly_top10(s, d):
    return _selected(s, d).select("symbol", "date", "sector", "position", r("score"), "weight")


@query(_PANEL + f", v AS (SELECT *, CASE WHEN eligible THEN roc21 END AS x, CASE WHEN eligible THEN -volume END AS y FROM pan) SELECT symbol, date, CASE WHEN x IS NOT NULL THEN round({_PCT.format(v='x')}, 9) END AS p, CASE WHEN y IS NOT NULL THEN round({_PCT.format(v='y')}, 9) END AS q FROM v")
def h1_pct_rank(s, d):
    e = C("eligible")
    return _panel(s, d).select("symbol", "date", F.round(selection.pct_rank("roc21", within=e), 9).alias("p"), F.round(selection.pct_rank("volume", "asc", within=e), 9).alias("q"))


@query(_PANEL + f""", v AS (SELECT *, CASE WHEN eligible THEN roc21 END AS x, CASE WHEN eligible AND volume > 20 THEN -volume END AS y FROM pan),
z AS (SELECT symbol, date, eligible, CASE WHEN x IS NOT NULL THEN {_PCT.format(v='x')} END AS p, CASE WHEN y IS NOT NULL THEN {_PCT.format(v='y')} END AS q FROM v)
SELECT symbol, date, CASE WHEN eligible THEN round((coalesce(p * 0.7, 0) + coalesce(q * 0.3, 0)) / nullif((CASE WHEN p IS NULL THEN 0 ELSE 0.7 END) + (CASE WHEN q IS NULL THEN 0 ELSE 0.3 END), 0), 6) END AS score FROM z""")
def h2_blend_rank(s, d):
    p = _panel(s, d).withColumn("v", F.when(C("volume") > 20, C("volume")))
    return selection.blend_rank(p, [("roc21", 0.7, "desc"), ("v", 0.3, "asc")]).select("symbol", "date", r("score"))


@query("SELECT 'nothing' AS factor")
def h3_empty_factors(s, d):
    return selection.empty_factors(fx.bars(s, d).withColumn("nothing", F.lit(None).cast("double")), ["close", "nothing"])


def _calendar(name: str, freq: str, sql: str) -> None:
    def fn(s, d):
        return selection.rebalance_dates(fx.bars(s, d), freq)

    fn.__name__ = name
    query(sql)(fn)


_calendar("h4_rebalance_weekly", "weekly", _WEEKS + " SELECT date FROM weeks")
_calendar("h4_rebalance_fortnightly", "fortnightly", _WEEKS + " SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM weeks) WHERE n % 2 = 1")
_calendar("h4_rebalance_monthly", "monthly", "SELECT min(date) AS date FROM bars GROUP BY date_trunc('month', date)")
_calendar("h4_rebalance_quarterly", "quarterly", "SELECT min(date) AS date FROM bars GROUP BY date_trunc('quarter', date)")


@query(_PANEL + """, k AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY volume, symbol) AS sr FROM pan WHERE volume IS NOT NULL)
SELECT symbol, date, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume, symbol) AS position FROM k WHERE sr <= 1) WHERE position <= 4""")
def h5_select_top_n(s, d):
    return selection.select_top_n(_panel(s, d), 4, 1, "asc", "volume").select("symbol", "date", "position")


@query(_TOP + " SELECT symbol, date, round(1 / count(*) OVER (PARTITION BY date), 9) AS weight FROM sel")
def h6_equal_weight(s, d):
    return selection.equal_weight(_selected(s, d), 10, True).select("symbol", "date", r("weight", 9))


_VOL = _TOP + """, iv AS (SELECT symbol, date, CASE WHEN volume > 20 THEN 1 / volume ELSE 0 END AS inv FROM sel),
wt AS (SELECT symbol, date, inv / CASE WHEN sum(inv) OVER (PARTITION BY date) > 0 THEN sum(inv) OVER (PARTITION BY date) ELSE 1 END AS weight FROM iv)"""


def _weighted(s, d):
    sel = _selected(s, d).withColumn("ret_vol", F.when(C("volume") > 20, C("volume")))
    return selection.inverse_vol_weight(sel)


@query(_VOL + " SELECT symbol, date, round(weight, 9) AS weight FROM wt")
def h7_inverse_vol_weight(s, d):
    return _weighted(s, d).select("symbol", "date", r("weight", 9))


@query(_VOL + """, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) - 1 AS k, count(*) OVER (PARTITION BY date) AS n, sum(weight) OVER (PARTITION BY date) AS t,
  sum(weight) OVER (PARTITION BY date ORDER BY weight DESC, symbol ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM wt),
l AS (SELECT *, (t - k * 0.3 - rest) / (n - k) AS lift FROM o),
b AS (SELECT *, first_value(CASE WHEN weight + lift <= 0.3 + 1e-12 THEN lift END IGNORE NULLS) OVER (PARTITION BY date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS up FROM l)
SELECT symbol, date, round(CASE WHEN t >= n * 0.3 - 1e-12 THEN 0.3 ELSE least(0.3, weight + coalesce(up, 0)) END, 9) AS weight FROM b""")
def h8_cap_weights(s, d):
    return selection.cap_weights(_weighted(s, d), 0.3).select("symbol", "date", r("weight", 9))


_REG = ", reg AS (SELECT date, close, CASE WHEN count(close) OVER w >= 50 THEN avg(close) OVER w END AS ma FROM bench WINDOW w AS (ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


@query(_TOP + _REG + " SELECT symbol, date, CASE WHEN coalesce(close_ < ma, false) THEN 0.05 ELSE 0.1 END AS weight FROM sel LEFT JOIN (SELECT date, close AS close_, ma FROM reg) USING (date)")
def h9_apply_regime(s, d):
    return selection.apply_regime(_selected(s, d), selection.regime(fx.bench(s, d), 50), "scale", 0.5).select("symbol", "date", "weight")


@query(_REG + " SELECT date, round(close, 9) AS close, round(ma, 6) AS ma, coalesce(close >= ma, false) AS \"on\", CASE WHEN coalesce(close >= ma, false) THEN 1.0 ELSE 0.25 END AS exposure FROM reg WHERE date = (SELECT max(date) FROM reg)")
def h10_regime_state(s, d):
    return selection.regime_state(fx.bench(s, d), 50, 0.25).select("date", r("close", 9), r("ma"), "on", "exposure")


@query(_TOP + f""", a AS (SELECT symbol, date, {_roll('avg', 'turnover', 20, 5)} AS adtv FROM bars),
o AS (SELECT symbol, date, close, CASE WHEN adtv > 0 THEN least(0.1 * 1000000, adtv * 0.1) ELSE 0.1 * 1000000 END AS notional FROM sel LEFT JOIN a USING (symbol, date))
SELECT symbol, date, round(notional, 6) AS notional, CAST(greatest(floor(notional / (close * (1 + 0.0011862))), 0) AS BIGINT) AS shares FROM o""")
def h11_size_orders(s, d):
    a = fx.bars(s, d).select("symbol", "date", ind.rolling(F.avg, C("turnover"), 20, 5).alias("adtv"))
    sel = _selected(s, d).join(a, ["symbol", "date"], "left").withColumn("price", C("close"))
    return selection.size_orders(sel, 1e6).select("symbol", "date", r("notional"), "shares")


@query(_TOP + " SELECT symbol, date, round(close - volume * 2, 6) AS stop, round(close - (close - volume * 2), 6) AS risk, CASE WHEN close - (close - volume * 2) > 0 THEN round(close + (close - (close - volume * 2)) * 2.5, 6) END AS target FROM sel")
def h12_stop_target(s, d):
    sel = _selected(s, d).withColumn("price", C("close")).withColumn("atr", C("volume"))
    return selection.stop_target(sel, ("atr", 2.0), ("r", 2.5)).select("symbol", "date", r("stop"), r("risk"), r("target"))


_NEXT = ", days AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM bars))"


@query(_TOP + _NEXT + " SELECT sel.symbol, sel.date, nd AS fill_date, b.open AS fill_price FROM sel JOIN days USING (date) JOIN bars b ON b.symbol = sel.symbol AND b.date = nd")
def h13_next_fill(s, d):
    return selection.next_fill(_selected(s, d), fx.bars(s, d)).select("symbol", "date", "fill_date", "fill_price")


@query(_TOP + """, a AS (SELECT symbol, round(close, 2) AS price FROM sel WHERE date = (SELECT max(date) FROM sel)), b AS (SELECT symbol FROM sel WHERE date = (SELECT max(date) FROM sel WHERE date < (SELECT max(date) FROM sel)))
SELECT coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'sell' WHEN b.symbol IS NULL THEN 'buy' ELSE 'hold' END AS action FROM a FULL JOIN b ON a.symbol = b.symbol""")
def h14_signal_diff(s, d):
    sel = _selected(s, d)
    last = sel.agg(F.max("date").alias("last"))
    before = sel.join(F.broadcast(last)).filter("date < last").agg(F.max("date").alias("before"))
    marked = sel.join(F.broadcast(last)).join(F.broadcast(before))
    today = marked.filter("date = last").select("symbol", C("close").alias("price"), "weight")
    return selection.signal_diff(today, marked.filter("date = before").select("symbol")).select("symbol", "action")


@query(f", c AS (SELECT symbol, date, (close / ({_SMA('close', 50)}) - 1) * 100 AS extension FROM bars) SELECT symbol, round(arg_max(row(extension), date)[1], 6) AS extension FROM c GROUP BY symbol")
def h15_entry_context(s, d):
    return selection.with_entry_context(fx.sectors(s, d).select("symbol"), fx.bars(s, d)).select("symbol", r("extension"))


@query(f", c AS (SELECT symbol, date, (close / ({_SMA('close', 50)}) - 1) * 100 AS extension FROM bars) SELECT symbol, round(arg_max(row(extension), date)[1], 6) AS extension FROM c GROUP BY symbol")
def h15_entry_context_all(s, d):
    return h15_entry_context(s, d)


@query("SELECT symbol, max(date) AS last_date, CAST(DATE '2002-01-01' - max(date) AS INTEGER) AS age, count(close) AS n_bars, DATE '2002-01-01' - max(date) > 30 AS stale, count(close) < 60 AS short_history FROM bars GROUP BY symbol")
def h16_freshness(s, d):
    return selection.freshness(fx.bars(s, d), "2002-01-01", 30)


@query("""SELECT symbol, action, surveillance, surveillance IS NOT NULL AND action = 'buy' AS warn FROM (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'buy' ELSE 'sell' END AS action FROM sectors)
LEFT JOIN (SELECT symbol, string_agg(f, '; ' ORDER BY list_type, stage) AS surveillance FROM (SELECT DISTINCT symbol, list_type, stage, list_type || ' ' || stage AS f FROM surv WHERE fetch_date = (SELECT max(fetch_date) FROM surv)) GROUP BY symbol) USING (symbol)""")
def h17_annotate(s, d):
    sig = fx.sectors(s, d).select("symbol", F.when(C("symbol") % 2 == 0, "buy").otherwise("sell").alias("action"))
    return selection.annotate(sig, pit.latest_flags(fx.surveillance(s, d)))


@query("""SELECT count(*) FILTER (a = 'buy') AS buys, count(*) FILTER (a = 'sell') AS sells, round(sum(CASE WHEN a = 'buy' THEN q * p END), 4) AS turnover,
  round(sum(CASE WHEN a = 'buy' THEN q * p END) * 0.0011862 + count(*) FILTER (a = 'sell') * 100000 * 0.0010362 + count(*) FILTER (a = 'sell') * 15.93, 4) AS cost
FROM (SELECT CASE WHEN symbol % 2 = 0 THEN 'buy' ELSE 'sell' END AS a, last_close AS p, floor(1000000 * 0.1 / last_close) AS q FROM (SELECT symbol, arg_max(adj_close, date) AS last_close FROM bars GROUP BY symbol))""")
def h18_order_sheet(s, d):
    sig = pit.latest_close(fx.bars(s, d)).select("symbol", C("last_close").alias("price"), F.lit(0.1).alias("weight"), F.when(C("symbol") % 2 == 0, "buy").otherwise("sell").alias("action"))
    return rounded(selection.order_sheet(sig, 1e6, 10), 4)


@query("""SELECT DISTINCT date, CAST(date_trunc('week', date) + INTERVAL 7 DAY AS DATE) AS weekly, date + 14 AS fortnightly, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS monthly,
  CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS quarterly FROM bars""")
def h19_next_rebalance(s, d):
    days = fx.bars(s, d).select("date").distinct()
    return days.select("date", *[selection.next_rebalance(C("date"), f).alias(f) for f in ("weekly", "fortnightly", "monthly", "quarterly")])


# ---- I: outcomes ------------------------------------------------------------------------------------------------------------
_SPANS = _TOP + _NEXT + """, no AS (SELECT date, row_number() OVER (ORDER BY date) AS no, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM sel)),
isl AS (SELECT symbol, date, nx, no - row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM sel JOIN no USING (date)),
run AS (SELECT symbol, i, min(date) AS a, arg_max(row(nx), date) AS b FROM isl GROUP BY ALL),
spans AS (SELECT symbol, x.nd AS entry_date, coalesce(y.nd, (SELECT max(date) FROM bars)) AS exit_date, CASE WHEN y.nd IS NOT NULL THEN 'rebalance' ELSE 'end' END AS exit_reason
  FROM run JOIN days x ON x.date = a LEFT JOIN days y ON y.date = b[1] WHERE x.nd IS NOT NULL)"""


def _spans(s, d):
    return outcomes.holding_spans(_selected(s, d), fx.bars(s, d))


@query(_SPANS + " SELECT symbol, entry_date, exit_date, exit_reason FROM spans")
def i1_holding_spans(s, d):
    return _spans(s, d)


# Spans from positions: from the entry to a planned end 120 days later.
_TOUCH = """, sp AS (SELECT position_id, symbol, entry_date, entry_date + 120 AS exit_date, stop, target FROM positions),
ov AS (SELECT sp.*, b.date, b.open, b.high, b.low, b.close, lead(b.date) OVER (PARTITION BY sp.position_id ORDER BY b.date) AS nxt FROM sp JOIN bars b ON b.symbol = sp.symbol AND b.date BETWEEN sp.entry_date AND sp.exit_date),
ev AS (SELECT position_id, symbol, entry_date, date, 1 AS p, CASE WHEN open >= stop THEN stop ELSE open END AS px, 'stop' AS why FROM ov WHERE low <= stop
  UNION ALL SELECT position_id, symbol, entry_date, date, 2, CASE WHEN open <= target THEN target ELSE open END, 'target' FROM ov WHERE high >= target
  UNION ALL SELECT position_id, symbol, entry_date, date, 3, close, 'time' FROM ov WHERE date - entry_date >= 60
  UNION ALL SELECT position_id, symbol, entry_date, date, 5, close, 'end' FROM ov WHERE nxt IS NULL),
tr AS (SELECT position_id, symbol, entry_date, min(date) AS exit_date, arg_min(px, row(date, p)) AS exit, arg_min(why, row(date, p)) AS exit_reason FROM ev GROUP BY ALL),
trades AS (SELECT tr.*, ov.open AS entry, ov.open - ov.stop AS risk FROM tr JOIN ov ON ov.position_id = tr.position_id AND ov.date = tr.entry_date)"""


def _trades(s, d):
    """A trade for every position, some of one symbol and day."""
    sp = fx.positions(s, d).select("position_id", "symbol", "entry_date", F.date_add("entry_date", 120).alias("exit_date"), F.lit("end").alias("exit_reason"), "stop", "target")
    out = outcomes.first_touch(sp, fx.bars_by_month(s, d), max_hold=60, keys=["position_id"])
    return out.withColumn("risk", C("entry") - C("stop"))


@query(_TOUCH + " SELECT position_id, exit_date, round(exit, 6) AS exit, exit_reason FROM trades")
def i2_i4_first_touch(s, d, trades=_trades):
    return trades(s, d).select("position_id", "exit_date", r("exit"), "exit_reason")


_NET = "(exit * (1 - 0.0010362 * {m})) / (entry * (1 + 0.0011862 * {m})) - 1"


@query(_TOUCH + f" SELECT position_id, round({_NET.format(m=1)}, 9) AS return_pct, CASE WHEN risk > 0 THEN round((exit - entry) / risk, 6) END AS r_multiple, CAST(exit_date - entry_date AS INTEGER) AS holding_days FROM trades")
def i6_trade_outcomes(s, d, trades=_trades):
    return outcomes.trade_outcomes(trades(s, d)).select("position_id", r("return_pct", 9), r("r_multiple"), "holding_days")


@query("SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_close FROM bars GROUP BY symbol HAVING max(date) < (SELECT max(date) FROM bars)")
def i5_delisting_dates(s, d):
    return outcomes.delisting_dates(fx.bars(s, d))


@query(_TOUCH + """, h AS (SELECT t.*, b.date, b.close, lag(b.close) OVER (PARTITION BY t.position_id ORDER BY b.date) AS pc FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.date BETWEEN t.entry_date AND t.exit_date),
q AS (SELECT date, 0.0001 * (CASE WHEN date = exit_date THEN exit ELSE close END / coalesce(pc, entry) - 1 - CASE WHEN date = entry_date THEN 0.0011862 ELSE 0 END - CASE WHEN date = exit_date THEN 0.0010362 ELSE 0 END) AS x FROM h),
dy AS (SELECT date, sum(x) AS ret, 0.0001 * count(*) AS exposure FROM q GROUP BY date)
SELECT date, round(ret, 9) AS ret, round(exposure, 9) AS exposure, round(1000000 * exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)), 3) AS nav FROM dy""")
def i7_nav_series(s, d, trades=_trades):
    t = trades(s, d).withColumn("weight", F.lit(0.0001))
    out = outcomes.nav_series(t, fx.bars(s, d), 1e6, trade=["position_id"])
    return out.select("date", r("ret", 9), r("exposure", 9), r("nav", 3))


@query(_TOUCH + """, h AS (SELECT b.date, count(*) * 0.0001 AS e FROM trades t JOIN bars b ON b.symbol = t.symbol AND b.date BETWEEN t.entry_date AND t.exit_date GROUP BY b.date)
SELECT round(avg(e), 9) AS exposure, round((SELECT count(*) * 0.0002 FROM trades) / 2 / (CAST(max(date) - min(date) AS DOUBLE) / 365.25), 9) AS turnover FROM h""")
def i8_exposure_turnover(s, d, trades=_trades):
    t = trades(s, d).withColumn("weight", F.lit(0.0001))
    nav = outcomes.nav_series(t, fx.bars(s, d), 1e6, trade=["position_id"])
    return rounded(outcomes.exposure(nav).join(outcomes.turnover(t, nav)))


@query(_PANEL + """, v AS (SELECT unnest([1, 2]) AS sector_cap), g AS (SELECT unnest([5, 10]) AS n),
k AS (SELECT pan.*, sector_cap, row_number() OVER (PARTITION BY sector_cap, date, sector ORDER BY roc21 DESC, symbol DESC) AS sr FROM pan, v WHERE eligible AND roc21 IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY sector_cap, date ORDER BY roc21 DESC, symbol DESC) AS p FROM k WHERE sr <= sector_cap),
m AS (SELECT 'n=' || n || ',sector_cap=' || sector_cap AS variant, avg(roc21) AS score FROM t, g WHERE p <= n GROUP BY ALL)
SELECT variant, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, variant) AS INTEGER) AS rank FROM m""")
def i9_sweep(s, d):
    grid = s.range(1).select(F.explode(F.array(F.lit(5), F.lit(10))).alias("n"))
    grid = grid.withColumn("sector_cap", F.explode(F.array(F.lit(1), F.lit(2))))
    grid = grid.select(F.format_string("n=%d,sector_cap=%d", "n", "sector_cap").alias("variant"), "n", "sector_cap")

    chosen = outcomes.top_n_variants(_panel(s, d), grid, "roc21")
    out = outcomes.ranked_variants(grid, chosen.groupBy("variant").agg(F.avg("roc21").alias("score")), "score")
    return out.select("variant", r("score"), "rank")


_WF = """, wf AS (SELECT row_number() OVER (ORDER BY s) - 1 AS window_, CAST(s AS DATE) AS is_start, CAST(s + INTERVAL 2 YEAR - INTERVAL 1 DAY AS DATE) AS is_end, CAST(s + INTERVAL 2 YEAR AS DATE) AS oos_start,
  least(CAST(s + INTERVAL 3 YEAR - INTERVAL 1 DAY AS DATE), DATE '2001-12-31') AS oos_end FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1999-12-30', INTERVAL 1 YEAR)) AS s))"""


@query(""", e AS (SELECT variant, min(date) AS a, max(date) AS z FROM nav GROUP BY variant),
st AS (SELECT variant, z, unnest(generate_series(CAST(a AS TIMESTAMP), z - INTERVAL 2 YEAR - INTERVAL 1 DAY, INTERVAL 1 YEAR)) AS s FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY s) - 1 AS w FROM st)
SELECT variant, CAST(w AS INTEGER) AS window, CAST(s AS DATE) AS is_start, CAST(s + INTERVAL 2 YEAR - INTERVAL 1 DAY AS DATE) AS is_end, CAST(s + INTERVAL 2 YEAR AS DATE) AS oos_start,
  least(CAST(s + INTERVAL 3 YEAR - INTERVAL 1 DAY AS DATE), z) AS oos_end FROM n""")
def i10_wf_windows(s, d):
    ends = fx.nav(s, d).groupBy("variant").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return outcomes.windows_between(ends, 2, 1).drop("start", "end")


_CAGR = "pow(arg_max(nav, date) / arg_min(nav, date), 1 / greatest(CAST(max(date) - min(date) AS DOUBLE) / 365.25, 1e-6)) - 1"


@query(_WF + f""", a AS (SELECT window_, variant, CASE WHEN count(*) >= 2 THEN {_CAGR} ELSE 0 END AS m FROM nav JOIN wf ON date BETWEEN is_start AND is_end GROUP BY ALL),
b AS (SELECT window_, variant, CASE WHEN count(*) >= 2 THEN {_CAGR} ELSE 0 END AS m FROM nav JOIN wf ON date BETWEEN oos_start AND oos_end GROUP BY ALL),
k AS (SELECT window_, arg_max(variant, row(m, variant)) AS variant, max(m) AS in_sample FROM a GROUP BY window_)
SELECT CAST(k.window_ AS INTEGER) AS window, k.variant, round(in_sample, 6) AS in_sample, round(b.m, 6) AS out_of_sample FROM k LEFT JOIN b ON b.window_ = k.window_ AND b.variant = k.variant""")
def i11_walk_forward(s, d):
    w = outcomes.wf_windows(s, "1995-01-01", "2001-12-31", 2, 1)
    return rounded(outcomes.walk_forward(fx.nav(s, d), w), 6).select("window", "variant", "in_sample", "out_of_sample")


@query(_TOUCH + f""" SELECT m AS cost_mult, count(*) AS n, round(avg({_NET.format(m='m')}), 9) AS mean_return, round(avg(CASE WHEN {_NET.format(m='m')} > 0 THEN 1.0 ELSE 0.0 END), 9) AS win_rate
FROM trades, (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS m) GROUP BY m""")
def i12_cost_sensitivity(s, d, trades=_trades):
    return rounded(outcomes.cost_sensitivity(trades(s, d)))


@query("SELECT date, round(max(nav) FILTER (variant = '1-URGENT'), 4) AS nav_a, round(max(nav) FILTER (variant = '5-LOW'), 4) AS nav_b FROM nav WHERE variant IN ('1-URGENT', '5-LOW') GROUP BY date")
def i13_compare(s, d):
    return rounded(outcomes.compare(fx.nav(s, d), "1-URGENT", "5-LOW"), 4)


# ---- J: performance ---------------------------------------------------------------------------------------------------------
@query(f""", x AS (SELECT variant, date, nav, nav / lag(nav) OVER (PARTITION BY variant ORDER BY date) - 1 AS q, nav / max(nav) OVER (PARTITION BY variant ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav)
SELECT variant, round(arg_max(nav, date) / arg_min(nav, date) - 1, 6) AS total_return, round({_CAGR}, 6) AS cagr, round(stddev_samp(q) * sqrt(252), 5) AS volatility,
  round(avg(q) / stddev_samp(q) * sqrt(252), 6) AS sharpe, round(avg(q) / stddev_samp(q) FILTER (q < 0) * sqrt(252), 6) AS sortino, round(min(dd), 6) AS max_drawdown FROM x GROUP BY variant""")
def j1_j4_returns_summary(s, d):
    out = performance.returns_summary(fx.nav(s, d))
    return out.select("variant", r("total_return"), r("cagr"), r("volatility", 5), r("sharpe"), r("sortino"), r("max_drawdown"))


@query("SELECT variant, date, round(nav / max(nav) OVER (PARTITION BY variant ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 9) AS drawdown FROM nav")
def j5_drawdown(s, d):
    return performance.drawdown(fx.nav(s, d)).select("variant", "date", r("drawdown", 9))


@query(""", x AS (SELECT variant, date, nav, max(nav) OVER (PARTITION BY variant ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM nav),
y AS (SELECT variant, arg_min(row(nav / pk - 1, date, pk), row(nav / pk - 1, date)) AS z FROM x GROUP BY variant)
SELECT y.variant, round(z[1], 9) AS max_drawdown, (SELECT min(date) FROM nav n WHERE n.variant = y.variant AND n.nav = z[3]) AS peak_date, z[2] AS trough_date FROM y""")
def j6_max_drawdown(s, d):
    return rounded(performance.max_drawdown(fx.nav(s, d)))


@query("""SELECT * FROM (SELECT variant, month, round(n / lag(n) OVER (PARTITION BY variant ORDER BY month) - 1, 6) AS ret FROM (
  SELECT variant, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(nav, date) AS n FROM nav GROUP BY ALL)) WHERE ret IS NOT NULL""")
def j7_monthly_returns(s, d):
    return rounded(performance.monthly_returns(fx.nav(s, d)), 6)


_STATS = _TOUCH + f""", o AS (SELECT exit_reason AS variant, {_NET.format(m=1)} AS q, exit_date - entry_date AS h FROM trades)"""


@query(_STATS + """ SELECT variant, count(*) AS n, round(avg(CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END), 9) AS win_rate, round(coalesce(avg(q) FILTER (q > 0), 0), 9) AS avg_win, round(coalesce(avg(q) FILTER (q <= 0), 0), 9) AS avg_loss,
  round(coalesce(CASE WHEN sum(q) FILTER (q <= 0) < 0 THEN sum(q) FILTER (q > 0) / -sum(q) FILTER (q <= 0) END, 0), 6) AS profit_factor, round(avg(h), 6) AS avg_holding_days FROM o GROUP BY variant""")
def j8_trade_stats(s, d, trades=_trades):
    t = outcomes.trade_outcomes(trades(s, d)).withColumn("variant", C("exit_reason"))
    out = performance.trade_stats(t)
    return out.select("variant", "n", r("win_rate", 9), r("avg_win", 9), r("avg_loss", 9), r("profit_factor"), r("avg_holding_days"))


# Once these were over every position and the queries above over one of a symbol and day; now both are over every position.
for _fn in (i2_i4_first_touch, i6_trade_outcomes, i7_nav_series, i8_exposure_turnover, i12_cost_sensitivity, j8_trade_stats):
    QUERIES[f"{_fn.__name__}_all"] = _fn
    ORACLES[f"{_fn.__name__}_all"] = ORACLES[_fn.__name__]


# A stop that trails three times the day's range under the peak of the days before.
_TRAIL = """, sp AS (SELECT position_id, symbol, entry_date, entry_date + 120 AS exit_date, stop FROM positions),
o1 AS (SELECT sp.*, b.date, b.open, b.high, b.low, b.close, b.high - b.low + 0.01 * b.close AS atr, lead(b.date) OVER w AS nxt, max(b.high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak
  FROM sp JOIN bars b ON b.symbol = sp.symbol AND b.date BETWEEN sp.entry_date AND sp.exit_date WINDOW w AS (PARTITION BY sp.position_id ORDER BY b.date)),
o2 AS (SELECT *, greatest(stop, max(peak - 3 * atr) OVER (PARTITION BY position_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS level FROM o1),
ev AS (SELECT position_id, date, 1 AS p, CASE WHEN open >= level THEN level ELSE open END AS px, 'stop' AS why FROM o2 WHERE low <= level
  UNION ALL SELECT position_id, date, 5, close, 'end' FROM o2 WHERE nxt IS NULL)
SELECT position_id, min(date) AS exit_date, round(arg_min(px, row(date, p)), 6) AS exit, arg_min(why, row(date, p)) AS exit_reason FROM ev GROUP BY position_id"""


@query(_TRAIL)
def i3_trailing_stop(s, d):
    p = fx.positions(s, d).select(
        "position_id", "symbol", "entry_date", F.date_add("entry_date", 120).alias("exit_date"), F.lit("end").alias("exit_reason"), "stop", F.lit(None).cast("double").alias("target")
    )
    b = fx.bars(s, d).withColumn("atr", C("high") - C("low") + 0.01 * C("close"))
    return outcomes.first_touch(p, b, trailing=3.0, keys=["position_id"]).select("position_id", "exit_date", r("exit"), "exit_reason")


@query(f""", b AS (SELECT {_CAGR} AS c FROM (SELECT date, close AS nav FROM bench))
SELECT variant, CASE WHEN variant <> '5-LOW' THEN round(c, 6) END AS benchmark_cagr, CASE WHEN variant <> '5-LOW' THEN round({_CAGR} - c, 6) END AS active_return, CASE WHEN variant = '5-LOW' THEN 'no meaningful exposure' END AS note
FROM nav, b GROUP BY variant, c""")
def j9_vs_benchmark(s, d):
    nav = fx.nav(s, d)
    stats = nav.groupBy("variant").agg(F.count("*").alias("n")).withColumn("exposure", F.when(C("variant") == "5-LOW", 0.001).otherwise(0.9))
    out = performance.vs_benchmark(performance.returns_summary(nav), fx.bench(s, d).withColumnRenamed("close", "nav"), stats)
    return out.select("variant", r("benchmark_cagr"), r("active_return"), "note")


@query("SELECT date, round(1000000 * close / first_value(close) OVER (ORDER BY date), 4) AS nav FROM bench")
def j10_rebase(s, d):
    return performance.rebase(fx.bench(s, d), 1e6).select("date", r("nav", 4))


# ---- K: the book ------------------------------------------------------------------------------------------------------------
_MARK = """, lc AS (SELECT symbol, arg_max(adj_close, date) AS px FROM bars GROUP BY symbol),
mk AS (SELECT p.*, px, CASE WHEN px <= stop THEN 'stop_hit' WHEN px >= target THEN 'target_hit' ELSE 'open' END AS status, CASE WHEN px <= stop THEN stop WHEN px >= target THEN target END AS exit FROM positions p LEFT JOIN lc USING (symbol)),
mr AS (SELECT *, coalesce(exit, px) / entry - 1 AS ret, CASE WHEN entry - stop > 0 THEN (coalesce(exit, px) - entry) / (entry - stop) END AS rm FROM mk)"""


def _marked(s, d):
    return book.mark_to_market(fx.positions(s, d), fx.bars(s, d))


@query(_TOP + " SELECT symbol, date AS entry_date, close AS entry, CAST(floor(15000 / close) AS BIGINT) AS shares, 'open' AS status FROM sel")
def k1_open_positions(s, d):
    sig = _selected(s, d).select("symbol", "date", C("close").alias("price"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("double").alias("target"), F.lit("buy").alias("action"))
    return book.open_positions(sig, 15000.0).select("symbol", "entry_date", "entry", "shares", "status")


@query(_MARK + " SELECT position_id, status, round(exit, 6) AS exit, round(ret, 6) AS return_pct, round(rm, 6) AS r_multiple FROM mr")
def k2_mark_to_market(s, d):
    return _marked(s, d).select("position_id", "status", r("exit"), r("return_pct"), r("r_multiple"))


@query(_MARK + " SELECT position_id, entry_date, status FROM mr WHERE status <> 'open' AND strategy_id = 'N'")
def k3_list_positions(s, d):
    return book.list_positions(_marked(s, d), "N", "closed").select("position_id", "entry_date", "status")


_BOARD = _MARK + """, bd AS (SELECT coalesce(strategy_id, 'unassigned') AS strategy_id, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status <> 'open') AS n_closed, sum((coalesce(exit, px, entry) - entry) * shares) AS pnl,
  avg(CASE WHEN status <> 'open' THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate, avg(ret) AS avg_return, avg(rm) AS avg_r FROM mr GROUP BY 1)"""


@query(_BOARD + " SELECT strategy_id, n_open, n_closed, round(pnl, 3) AS pnl, round(win_rate, 6) AS win_rate, round(avg_return, 6) AS avg_return, round(avg_r, 6) AS avg_r FROM bd")
def k4_scoreboard(s, d):
    out = book.scoreboard(_marked(s, d))
    return out.select("strategy_id", "n_open", "n_closed", r("pnl", 3), r("win_rate"), r("avg_return"), r("avg_r"))


@query(_BOARD + """ SELECT CASE WHEN symbol % 2 = 0 THEN 'new_signal' ELSE 'exit_signal' END AS kind, CAST(symbol AS VARCHAR) AS symbol, NULL AS strategy_id, round(px, 6) AS value FROM lc
UNION ALL SELECT status, CAST(symbol AS VARCHAR), strategy_id, round(exit, 6) FROM mr WHERE status <> 'open' UNION ALL SELECT 'drawdown_breach', NULL, strategy_id, round(avg_return, 6) FROM bd WHERE avg_return <= -0.15""")
def k5_build_alerts(s, d):
    sig = pit.latest_close(fx.bars(s, d)).select("symbol", C("last_close").alias("price"), F.when(C("symbol") % 2 == 0, "buy").otherwise("sell").alias("action"))
    m = _marked(s, d)
    return rounded(book.build_alerts(sig, m, book.scoreboard(m)), 6)


# ---- L: audits --------------------------------------------------------------------------------------------------------------
@query("SELECT count(DISTINCT symbol) AS n_symbols, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM bars")
def l1_coverage(s, d):
    return audit.coverage(fx.bars(s, d))


@query("SELECT count(DISTINCT symbol) AS ever, count(DISTINCT symbol) FILTER (date >= (SELECT max(date) - 14 FROM mcap)) AS now, count(DISTINCT symbol) FILTER (symbol % 5 = 0) AS delisted FROM mcap")
def l2_universe_coverage(s, d):
    return audit.universe_coverage(fx.mcap(s, d), fx.sectors(s, d).filter("symbol % 5 = 0"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def l3_duplicate_keys(s, d):
    return audit.duplicate_keys(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) FILTER (close - 1500 <= 0) AS bad_close, count(*) FILTER (volume - 10 < 0) AS negative_volume, count(*) FILTER (adj_close IS NULL OR adj_close <= 0) AS bad_adj_close, count(*) FILTER (close < open) AS high_below_low FROM bars""")
def l4_bad_values(s, d):
    b = fx.bars(s, d)
    return audit.bad_values(b.select((C("close") - 1500).alias("close"), (C("volume") - 10).alias("volume"), "adj_close", C("close").alias("high"), C("open").alias("low")))


@query(f"SELECT symbol, date, round(ret, 6) AS ret FROM (SELECT symbol, date, close / lag(close) {W}) - 1 AS ret FROM bars) WHERE abs(ret) > 0.5 ORDER BY abs(ret) DESC, symbol, date LIMIT 25")
def l5_return_outliers(s, d):
    return rounded(audit.return_outliers(fx.bars(s, d)), 6)


@query("SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol HAVING max(date) < (SELECT max(date) - 10 FROM bars)")
def l6_stale_symbols(s, d):
    return audit.stale_symbols(fx.bars(s, d))


@query("SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol HAVING count(*) < 530")
def l7_thin_symbols(s, d):
    return audit.thin_symbols(fx.bars(s, d), 530)


@query("""SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (b.k IS NULL) AS n_left_only, count(*) FILTER (a.k IS NULL) AS n_right_only
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 > 0) a FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 4 > 0) b ON a.k = b.k""")
def l8_join_coverage(s, d):
    o, c = fx.table(s, d, "orders").select(C("o_custkey").alias("k")), fx.table(s, d, "customer").select(C("c_custkey").alias("k"))
    return audit.join_coverage(o.filter("k % 3 > 0"), c.filter("k % 4 > 0"), "k")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def l8_left_only(s, d):
    o, c = fx.table(s, d, "orders").select(C("o_custkey").alias("k")), fx.table(s, d, "customer").select(C("c_custkey").alias("k"))
    return audit.left_only(c, o, "k")


@query(f""", x AS (SELECT close, {_ROC(21)} AS roc21 FROM bars) SELECT 'close' AS field, count(*) FILTER (close IS NULL) AS n_null, round(count(*) FILTER (close IS NULL) / count(*), 9) AS rate FROM x
UNION ALL SELECT 'roc21', count(*) FILTER (roc21 IS NULL), round(count(*) FILTER (roc21 IS NULL) / count(*), 9) FROM x""")
def l9_null_rates(s, d):
    return rounded(audit.null_rates(fx.bars(s, d).select("close", ind.roc(C("close"), 21).alias("roc21"))))


@query("SELECT '^' || symbol AS symbol, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date, count(*) > 535 AS healthy FROM bars WHERE symbol % 2 = 0 GROUP BY 1")
def l10_benchmark_health(s, d):
    b = fx.bars(s, d).withColumn("symbol", F.concat(F.when(C("symbol") % 2 == 0, "^").otherwise("_"), C("symbol").cast("string")))
    return audit.benchmark_health(b, least=535)


_COV = f""", x AS (SELECT date, close, {_ROC(21)} AS roc21, CASE WHEN date >= DATE '1999-01-01' THEN volume END AS late FROM bars),
cov AS (SELECT 'close' AS feature, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM x UNION ALL SELECT 'roc21', min(date), max(date), count(*) FROM x WHERE roc21 IS NOT NULL UNION ALL SELECT 'late', min(date), max(date), count(*) FROM x WHERE late IS NOT NULL)"""


def _cov(s, d):
    b = fx.bars(s, d)
    p = b.select("symbol", "date", "close", ind.roc(C("close"), 21).alias("roc21"), F.when(C("date") >= F.lit("1999-01-01").cast("date"), C("volume")).alias("late"))
    return audit.feature_coverage(p, ["close", "roc21", "late"], {"late": "snapshot"})


@query(_COV + " SELECT feature, first_date, last_date, n, CASE WHEN feature = 'late' THEN 'snapshot' ELSE 'price' END AS source FROM cov")
def l11_feature_coverage(s, d):
    return _cov(s, d)


@query(_COV + " SELECT CASE WHEN (SELECT first_date FROM cov WHERE feature = 'late') > DATE '1998-01-01' THEN 'backtestable' ELSE 'fully-backtestable' END AS verdict")
def l11_readiness(s, d):
    return audit.readiness(_cov(s, d), {"close": "filter", "late": "rank"}, "1998-01-01").select("verdict")


@query("SELECT count(DISTINCT date) AS n_snapshots, count(DISTINCT id) AS n_symbols, max(date) AS latest, CAST(DATE '2002-03-01' - max(date) AS INTEGER) AS age, DATE '2002-03-01' - max(date) > 35 AS stale FROM eav")
def l12_snapshot_coverage(s, d):
    return audit.snapshot_coverage(fx.eav(s, d).select(C("id").alias("symbol"), C("date").alias("snapshot_date")), "2002-03-01")


@query(_LAG + " SELECT count(*) AS n, round(avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END), 9) AS matched, quantile_cont(lag_days, 0.5) FILTER (matched) AS median, round(quantile_cont(lag_days, 0.1) FILTER (matched), 6) AS p10, round(quantile_cont(lag_days, 0.9) FILTER (matched), 6) AS p90 FROM lag_")
def l13_lag_stats(s, d):
    out = audit.lag_stats(_lag(s, d))
    return out.select("n", r("matched", 9), "median", r("p10"), r("p90"))


@query("SELECT symbol, round(arg_max(adj_close, date) / arg_min(adj_close, date) - 1, 6) AS adjusted_return, true AS ok FROM bars GROUP BY symbol")
def l14_integrity_checks(s, d):
    b = fx.bars(s, d)
    return audit.integrity_checks(b, panel.adjust_ohlc(b)).select("symbol", r("adjusted_return"), "ok")


@query("SELECT event_type AS list_type, count(*) AS n FROM events GROUP BY 1")
def l15_counts_by(s, d):
    return audit.counts_by(fx.surveillance(s, d), "list_type")


@query("SELECT 'close' AS feature, count(close) AS n_dead, count(close) = 0 AS survivors_only FROM bars WHERE symbol % 5 = 0 UNION ALL SELECT 'live', 0, true")
def l16_survivorship_coverage(s, d):
    b = fx.bars(s, d)
    p = b.select("symbol", "close", F.when(C("symbol") % 5 > 0, C("close")).alias("live"))
    return audit.survivorship_coverage(p, b.filter("symbol % 5 = 0"), ["close", "live"])


@query("SELECT count(*) FILTER (symbol % 10 = 0) AS n_uncertain, count(*) AS n_delisted FROM sectors WHERE symbol % 5 = 0")
def l17_uncertain_count(s, d):
    sec = fx.sectors(s, d)
    return audit.uncertain_count(sec, sec.filter("symbol % 5 = 0").withColumn("ca_uncertain", C("symbol") % 10 == 0))


# ---- A: sources over texts that Spark derives from the tables ---------------------------------------------------------------
@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS value FROM supplier")
def a7_clean_number(s, d):
    t = fx.table(s, d, "supplier")
    text = F.when(C("s_suppkey") % 7 == 0, "N/A").otherwise(F.concat(F.lit("₹ "), F.format_number("s_acctbal", 2), F.lit(" %")))
    return t.select(C("s_suppkey").alias("id"), clean_number(text).alias("value"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) END AS period_end,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def a8_period_end(s, d):
    o = fx.table(s, d, "orders")
    label = F.when(C("o_orderkey") % 5 == 0, "TTM").when(C("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.date_format("o_orderdate", "MMM-yyyy"))
    day = F.when(C("o_orderkey") % 3 == 0, "-").when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(C("o_orderkey").alias("id"), period_end(label).alias("period_end"), clean_date(day).alias("day"))


@query("""SELECT CAST(ts AS DATE) AS fetch_date, 'U' || user_id AS symbol, CASE WHEN event_type IN ('click', 'view') THEN 'ASM-LT' ELSE 'GSM' END AS list_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS stage FROM events""")
def a11_flatten_surveillance(s, d):
    e = fx.table(s, d, "events")
    item = F.struct(F.concat(F.lit("u"), C("user_id").cast("string"), F.lit(".NS")).alias("symbol"), F.get_json_object("props", "$.k").alias("asmSurvIndicator"))
    graded = F.struct(item["symbol"].alias("symbol"), item["asmSurvIndicator"].alias("gsmStage"))
    watched = C("event_type").isin("click", "view")
    asm = F.when(watched, F.to_json(F.struct(F.struct(F.array(item).alias("data")).alias("longterm"))))
    raw = e.select(F.to_date("ts").alias("fetch_date"), asm.alias("asm"), F.when(~watched, F.to_json(F.array(graded))).alias("gsm"))
    return readers.flatten_surveillance(raw)


@query("SELECT symbol, 'buy' AS action, CASE WHEN symbol % 3 > 0 THEN px END AS price, NULL AS stop FROM (SELECT symbol, arg_max(adj_close, date) AS px FROM bars GROUP BY symbol)")
def a13_order_rows(s, d):
    last = pit.latest_close(fx.bars(s, d))
    price = F.when(C("symbol") % 3 > 0, C("last_close")).otherwise(F.lit(float("nan")))
    return readers.order_rows(last.select("symbol", F.lit("buy").alias("action"), price.alias("price"))).select("symbol", "action", "price", "stop")


@query("SELECT upper(s_name) AS symbol, s_name AS name, r_name AS sector FROM supplier JOIN sectors ON symbol = s_suppkey JOIN region ON r_name = sector WHERE s_suppkey % 4 > 0")
def a14_normalize_universe(s, d):
    t = fx.table(s, d, "supplier").join(fx.sectors(s, d), C("s_suppkey") == C("symbol"))
    raw = t.select(
        F.concat(F.lit(" "), "s_name", F.lit(".NS")).alias("NSE Symbol"), C("s_name").alias("Company Name"), C("sector").alias("Industry"), F.when(C("s_suppkey") % 4 == 0, "BE").otherwise("EQ").alias("Series")
    )
    return readers.normalize_universe(raw).select("symbol", "name", "sector")


# Two sources of a symbol's mean price: its bars, and the orders' lines through their parts' list prices.
@query("""SELECT metric, round(value, 6) AS value, round(expected, 6) AS expected, round(value - expected, 6) AS diff, CASE WHEN abs(value - expected) <= 40 THEN 'ok' ELSE 'off' END AS status FROM
  (SELECT symbol AS metric, avg(close) AS value FROM bars GROUP BY symbol) JOIN
  (SELECT l_suppkey AS metric, avg(p_retailprice) AS expected FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey) USING (metric)""")
def l14_tolerance_check(s, d):
    got = fx.bars(s, d).groupBy(C("symbol").alias("metric")).agg(F.avg("close").alias("value"))
    part = fx.table(s, d, "part").select(C("p_partkey").alias("l_partkey"), "p_retailprice")
    listed = fx.table(s, d, "lineitem").join(part, "l_partkey").groupBy(C("l_suppkey").alias("metric")).agg(F.avg("p_retailprice").alias("value"))
    return rounded(audit.tolerance_check(got, listed, 40.0), 6)

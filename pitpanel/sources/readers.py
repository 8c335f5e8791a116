"""Reading daily bars, tables and snapshots into the canonical long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import canon_symbol, finite
from ..functions.keys import split_by_keys

#: Series of equities that daily bar files hold (fixed values).
EQUITY_SERIES = ("EQ", "BE", "BZ", "SM", "ST")
CUTOVER = "2024-07-08"
_NUMBERS = ("open", "high", "low", "close", "last", "prev_close", "volume", "turnover", "n_trades")
#: Column of each field in the two file formats (fixed values).
_LEGACY = dict(
    symbol="SYMBOL", series="SERIES", isin="ISIN", open="OPEN", high="HIGH", low="LOW", close="CLOSE", last="LAST", prev_close="PREVCLOSE",
    volume="TOTTRDQTY", turnover="TOTTRDVAL", n_trades="TOTALTRADES",
)
_UDIFF = dict(
    symbol="TckrSymb", series="SctySrs", isin="ISIN", open="OpnPric", high="HghPric", low="LwPric", close="ClsPric", last="LastPric",
    prev_close="PrvsClsgPric", volume="TtlTradgVol", turnover="TtlTrfVal", n_trades="TtlNbOfTxsExctd",
)


def _texts(spark: SparkSession, path) -> DataFrame:
    """CSV files as text columns, with the path of each row's file."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.withColumn("_path", F.col("_metadata.file_path"))


def _bars(raw: DataFrame, columns: dict[str, str], day: str) -> DataFrame:
    found = {c.strip().upper(): c for c in raw.columns}
    get = lambda name: F.trim(F.col(f"`{found[name.upper()]}`")) if name.upper() in found else F.lit(None).cast("string")
    texts = {k: get(v) for k, v in columns.items()}
    date = F.coalesce(
        F.try_to_date(get(day), "dd-MMM-yyyy"), F.try_to_date(get(day), "yyyy-MM-dd"),
        F.try_to_date(F.regexp_extract(get("_path"), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
    )
    typed = raw.select(
        canon_symbol(texts["symbol"]).alias("symbol"), date.alias("date"), texts["isin"].alias("isin"), texts["series"].alias("series"),
        *[texts[c].try_cast("double").alias(c) for c in _NUMBERS],
    )
    return typed.filter(F.col("series").isin(*EQUITY_SERIES) & F.col("close").isNotNull())


def legacy_bars(raw: DataFrame) -> DataFrame:
    """Bars from text columns of the older format; the date is TIMESTAMP or, without it, a yyyy-MM-dd in the column _path."""
    return _bars(raw, _LEGACY, "TIMESTAMP")


def udiff_bars(raw: DataFrame) -> DataFrame:
    """Bars from text columns of the newer format."""
    return _bars(raw, _UDIFF, "TradDt")


def both_bars(legacy: DataFrame, udiff: DataFrame, cutover: str = CUTOVER) -> DataFrame:
    """Bars of both formats as one table: the older one before the cut-over date, the newer one from it on."""
    day = F.lit(cutover).cast("date")
    return legacy.filter(F.col("date") < day).unionByName(udiff.filter(F.col("date") >= day), allowMissingColumns=True)


def read_bars_legacy(spark: SparkSession, path) -> DataFrame:
    return legacy_bars(_texts(spark, path))


def read_bars_udiff(spark: SparkSession, path) -> DataFrame:
    return udiff_bars(_texts(spark, path))


def read_bars(spark: SparkSession, legacy, udiff, cutover: str = CUTOVER) -> DataFrame:
    return both_bars(read_bars_legacy(spark, legacy), read_bars_udiff(spark, udiff), cutover)


def read_csv_table(spark: SparkSession, glob: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """A folder of CSV files as one table. Without a schema types come from all rows; a malformed row fails the read.

    multi_line is for files with line ends inside of quotes; Spark can't split such a file, so each is read by one task.
    """
    options = {"header": True, "mode": "FAILFAST", "escape": '"', "multiLine": multi_line}
    if schema is None:
        schema = spark.read.options(inferSchema=True, **options).csv(glob).schema
    return spark.read.options(**options).schema(schema).csv(glob)


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows and types of each table."""
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(", ".join(f"{c} {t}" for c, t in df.dtypes)).alias("types"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def merge_column_groups(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """One row a key; each field takes the first non-null value in the order of the frames."""
    tagged = [df.withColumn("_order", F.lit(i)) for i, df in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    fields = [c for c in both.columns if c not in (key, "_order")]
    return both.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in fields])


def newest_by_key(df: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """One row a key: that of the greatest order_col, then of the least values."""
    order = [F.desc_nulls_last(order_col)] if order_col else []
    rest = [F.asc_nulls_last(c) for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order, *(rest or [F.lit(0)]))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order_col: str | None = None) -> DataFrame:
    """base with incoming rows in place of those of the same key; of several incoming the greatest order_col counts, then the least values.

    Rows of base are compared by key only, and only those are shuffled whose key may be among the incoming ones by a bitmap of
    bounded size; the rest pass through, so what is moved and sorted follows the increment. base has a row a key. Null keys equal each other.
    """
    newest = newest_by_key(incoming, keys, order_col)
    kinds = dict(base.dtypes)
    named = incoming.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys])
    touched, others = split_by_keys(base, keys, named)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_incoming_{k}")) for k in keys])
    kept = touched.join(named.distinct().toDF(*[f"_incoming_{k}" for k in keys]), same, "left_anti")
    return others.union(kept).unionByName(newest, allowMissingColumns=True)


def replace_partition(df: DataFrame, path: str, col: str = "snapshot_date") -> None:
    """Writes df so that its dates replace those at the path and all other dates stay."""
    df.write.partitionBy(col).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def with_snapshot_date(df: DataFrame, bars: DataFrame, col: str = "snapshot_date") -> DataFrame:
    """df with the latest bar date as its snapshot date where it has none."""
    last = F.broadcast(bars.agg(F.max("date").alias("_last")))
    own = F.col(col) if col in df.columns else F.lit(None).cast("date")
    return df.join(last).withColumn(col, F.coalesce(own, F.col("_last"))).drop("_last")


_ITEM = "struct<symbol:string,companyName:string,asmSurvIndicator:string,gsmStage:string>"
_PAYLOAD = f"struct<longterm:struct<data:array<{_ITEM}>>,shortterm:struct<data:array<{_ITEM}>>>"


def flatten_surveillance(raw: DataFrame) -> DataFrame:
    """fetch_date, symbol, list_type, stage from raw (fetch_date, asm, gsm): JSON of the two-term lists and of the graded list."""
    asm = F.from_json("asm", _PAYLOAD)
    parts = [
        raw.select("fetch_date", F.lit(kind).alias("list_type"), F.inline(items))
        for kind, items in (
            ("ASM-LT", asm["longterm"]["data"]), ("ASM-ST", asm["shortterm"]["data"]), ("GSM", F.from_json("gsm", f"array<{_ITEM}>")),
        )
    ]
    rows = reduce(DataFrame.unionByName, parts).filter("symbol is not null and trim(symbol) <> ''")
    return rows.select("fetch_date", canon_symbol(F.col("symbol")).alias("symbol"), "list_type", F.coalesce("asmSurvIndicator", "gsmStage").alias("stage"))


def new_dates_only(source: DataFrame, have: DataFrame, col: str = "date") -> DataFrame:
    return source.join(have.select(col).distinct(), col, "left_anti")


def incremental(source: DataFrame, base: DataFrame, overlap_days: int = 7, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """base with the source's rows from the last date less the overlap on."""
    last = F.broadcast(base.agg(F.max("date").alias("_last")))
    fresh = source.join(last).filter(F.col("_last").isNull() | (F.col("date") >= F.date_sub("_last", overlap_days))).drop("_last")
    return upsert(base, fresh, keys)


#: Columns of an exported signal list, in order (fixed values of the format).
ORDER_COLUMNS = ("symbol", "action", "price", "stop", "target", "weight", "shares", "sector", "rank", "note")


def order_rows(df: DataFrame) -> DataFrame:
    """The signal list in its fixed column order, missing ones empty, NaN and infinities null."""
    kinds = dict(df.dtypes)
    value = lambda c: finite(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*[(value(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in ORDER_COLUMNS])


def write_orders(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = order_rows(df).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.option("ignoreNullFields", False).json(path)


def normalize_universe(raw: DataFrame) -> DataFrame:
    """symbol, name, sector, isin of equity rows; columns may go by any of their usual names."""
    alias = {
        "symbol": ("symbol", "ticker", "nse symbol", "nsecode"), "name": ("company name", "name", "company", "stock name"),
        "sector": ("industry", "sector", "sector_name"), "isin": ("isin code", "isin", "isin_code"), "series": ("series",),
    }
    found = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[F.trim(F.col(f"`{found[n]}`").cast("string")) for n in names if n in found], F.lit(None).cast("string"))
    rows = raw.select(*[pick(v).alias(k) for k, v in alias.items()])
    rows = rows.filter((F.coalesce("series", F.lit("EQ")) == "EQ") & F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    return rows.select(canon_symbol(F.col("symbol")).alias("symbol"), "name", "sector", "isin").dropDuplicates(["symbol"])


def load_coverage(requested: DataFrame, got: DataFrame) -> DataFrame:
    """requested, ok, failed, coverage of a load, by symbol."""
    ok = got.select("symbol").distinct().withColumn("_ok", F.lit(True))
    joined = requested.select("symbol").distinct().join(ok, "symbol", "left")
    sums = joined.agg(F.count("*").alias("requested"), F.count_if(F.col("_ok")).alias("ok"))
    return sums.select("requested", "ok", (F.col("requested") - F.col("ok")).alias("failed"), F.coalesce(F.try_divide("ok", "requested"), F.lit(0.0)).alias("coverage"))


def normalize_bars(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Dates without time, adj_close from close where missing, no rows without any price, one row a symbol and date (the last)."""
    prices = [c for c in ("open", "high", "low", "close", "adj_close") if c in df.columns]
    df = df.withColumn("date", F.to_date("date")).withColumns({c: finite(F.col(c).cast("double")) for c in prices}).dropna("all", subset=prices)
    adjusted = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    df = df.withColumn("adj_close", adjusted)
    rest = [F.desc_nulls_last(c) for c in ([order_col] if order_col else []) + prices]
    w = Window.partitionBy("symbol", "date").orderBy(*rest)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

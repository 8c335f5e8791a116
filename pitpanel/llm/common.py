"""Helpers shared by the corpus operators: table access, checkpoints, word hashing, blocks."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass inside a task looks at.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that goes to a Python worker; Spark's default holds eight times as much in the executor and in the worker.
BATCH_BYTES = "8m"
_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)
_KEYS = ("pitpanel-lane-00", "pitpanel-lane-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evaluated_once(function: Callable, kind: str | T.DataType, *columns: Column) -> Column:
    """A pandas function of columns, in batches of bounded bytes.

    It is declared nondeterministic so that the optimizer, when it moves filters (also those that it infers from joins), puts no
    second copy of the Python evaluation below them.
    """
    bounded_batches(SparkSession.active())
    return F.pandas_udf(function, kind).asNondeterministic()(*columns)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes, as texts differ much in length, where the user has set no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Bounds Arrow batches by other bytes while an operator runs its jobs, where the user has set no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before not in (None, BATCH_BYTES):
        yield
        return
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before or BATCH_BYTES)


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _written(df: DataFrame, **options) -> tuple[str, DataFrame]:
    path = f"{_shared_folder(df.sparkSession)}/pitpanel-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that spark.checkpoint.dir names, read again; one is made only where it is unset.

    Unlike DataFrame.checkpoint a table carries no constraints of the plan before it, which grow with every round of a loop.
    The table stays until that folder is cleared, as one does between applications; see Scratch for shorter lives.
    """
    return _written(df)[1]


class Scratch:
    """Tables like those of `checkpoint` for the steps of one job; on leaving, those go that aren't handed to `keep`.

    What an operator returns is a plan that still reads some of them, and these must be kept.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(t for _, t in self.tables))

    def table(self, df: DataFrame, **options) -> DataFrame:
        """The rows as a table, written with these options of Parquet."""
        self.tables.append(_written(df, **options))
        return self.tables[-1][1]

    def drop(self, *gone: DataFrame) -> None:
        context = self.spark.sparkContext
        for path, _ in self._parted(gone):
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def keep(self, *tables: DataFrame) -> None:
        self._parted(tables)

    def _parted(self, tables: Iterable[DataFrame]) -> list[tuple[str, DataFrame]]:
        """Takes these tables out of the list."""
        ids = {id(t) for t in tables}
        out = [x for x in self.tables if id(x[1]) in ids]
        self.tables = [x for x in self.tables if id(x[1]) not in ids]
        return out


#: Bits of an id bitmap for each id, and at most: 2 ** 27 bits are a broadcast of 16 MB.
BITS_PER_ID, MAX_BITS = 16, 1 << 27


def tight(count: int) -> bool:
    """Whether a bitmap of so many ids lets few others pass."""
    return count * BITS_PER_ID <= MAX_BITS


def split_by_ids(rows: DataFrame, key: Column, ids: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among the ids (a frame of one long column), and rows whose key surely isn't; a null key isn't.

    A bitmap of hashed ids, of bounded size, is broadcast, so that an exact join shuffles the first part only. Beyond
    MAX_BITS / BITS_PER_ID ids more and more rows fall into the first part, which costs time and nothing else.
    """
    bits = max(1 << 15, min(MAX_BITS, 1 << (BITS_PER_ID * max(1, count) - 1).bit_length()))
    bucket, held, may = (unused(x, rows.columns) for x in ("bucket", "bits", "may_be"))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    position = at(F.col(ids.columns[0]))
    bitmap = ids.groupBy(F.bitmap_bucket_number(position).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias(held)
    )
    place = F.bitmap_bit_position(at(key))
    byte = F.conv(F.hex(F.substring(held, (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    may_be = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & key.isNotNull()
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(at(key))).join(F.broadcast(bitmap), bucket, "left").withColumn(may, may_be)
    return marked.filter(F.col(may)).select(*rows.columns), marked.filter(~F.col(may)).select(*rows.columns)


def unused(name: str, taken: Sequence[str]) -> str:
    """A column name that isn't taken, in either case of letters."""
    names = {x.lower() for x in taken}
    while name.lower() in names:
        name += "_"
    return name


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


#: Text that a block holds, whatever the size of the corpus: what a task has in memory doesn't grow.
BLOCK_BYTES = 4_000_000


def block_count(total_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / BLOCK_BYTES))


def with_block(docs: DataFrame, blocks: int, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id (0 for null) and known (whether it isn't null), text, block and the carried columns under other names (_carried_0 and so on).

    Rows that share an id and a text share a block; what follows groups by block in Python. No column of integers has nulls, which pandas would make floats of.
    """
    bounded_batches(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"),
        own.isNotNull().alias("known"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text"))), F.lit(blocks)).cast("int").alias("block"),
        *[F.col(c).alias(f"_carried_{i}") for i, c in enumerate(carry)],
    )


def restored(rows: DataFrame) -> DataFrame:
    """doc_id as it was before with_block, without the column known."""
    return rows.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def corpus_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(n_bytes(F.col("text"))).alias("n")).first()["n"] or 0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64 constants)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    codes, unique = pd.factorize(flat)
    return codes, np.asarray(unique, dtype=object)


def word_hashes(codes: np.ndarray, unique: np.ndarray, lane: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of every word; two lanes make 128 bits."""
    if not len(unique):
        return np.zeros(0, _U64)
    return pd.util.hash_array(unique, hash_key=_KEYS[lane], categorize=False)[codes]


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; entry i starts at word i. Runs across documents are included."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out = hashed[:n].copy()
    for k in range(1, width):
        out *= _MULT
        out += hashed[k : k + n]
    return mix(out)


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """For documents of these word counts laid end to end: the starts of windows within one document."""
    total = int(lengths.sum())
    if total < width:
        return np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.arange(total, dtype=np.int64)
    return starts[starts + width <= ends]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of the list holding about `limit` bytes; a longer text makes a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

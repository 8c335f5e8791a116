"""Vector bin packing of documents into shards, jointly by bytes, tokens and rows.

Groups of equal texts are the things that are placed. They are far too many to place one by one, so all
small groups are first hashed into a fixed number of cells; cells and large groups are the units of packing.
Only a group that no shard could hold is cut into pieces, by doc_id. The number of units has a
bound that doesn't depend on the corpus, so the placement itself is a short loop on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_bytes

CELLS = 4096
HOT_PARTS = 64
SLOT_ROWS = 20_000
_DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit. vectors: a row per unit, each column scaled to a total of 1.

    Largest units first; each goes to the shard, among those with room in every dimension, where the dot
    product with the residual capacity is highest. Without room anywhere the shard whose tightest dimension
    is least overfilled takes it. Ties go to the lower shard.
    """
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else []:
        v = vectors[i]
        fits = (residual >= v - 1e-12).all(axis=1)
        if fits.any():
            best = int(np.argmax(np.where(fits, residual @ v, -np.inf)))
        else:
            best = int(np.argmax((residual - v).min(axis=1)))
        residual[best] -= v
        out[i] = best
    return out


#: What uneven bytes, tokens and rows weigh when units are swapped; the law that the result follows is on bytes.
WEIGHTS = (4.0, 1.0, 1.0)


def even_out(vectors: np.ndarray, placed: np.ndarray, shards: int, rounds: int = 300) -> np.ndarray:
    """Swaps a unit of one shard with a unit, or nothing, of another while that evens all dimensions together.

    Each round takes the shards that are furthest apart in some dimension and the swap that brings both nearest to their mean,
    by the weighted squares of all dimensions; it ends when no such swap is left in any dimension.
    """
    placed, scaled = placed.copy(), vectors * np.sqrt(np.array(WEIGHTS[: vectors.shape[1]]))
    totals = np.stack([np.bincount(placed, weights=scaled[:, d], minlength=shards) for d in range(scaled.shape[1])], axis=1)
    for _ in range(rounds if len(placed) else 0):
        for d in np.argsort(-np.ptp(totals, axis=0), kind="stable"):
            high, low = int(totals[:, d].argmax()), int(totals[:, d].argmin())
            half = (totals[high] - totals[low]) / 2
            ours, theirs = np.flatnonzero(placed == high), np.append(np.flatnonzero(placed == low), -1)
            mine, other = scaled[ours], np.append(scaled[theirs[:-1]], np.zeros((1, scaled.shape[1])), axis=0)
            left = sum((mine[:, k, None] - (other[None, :, k] + half[k])) ** 2 for k in range(scaled.shape[1]))
            a, b = np.unravel_index(left.argmin(), left.shape) if left.size else (0, 0)
            if left.size and left[a, b] < (half**2).sum() * (1 - 1e-9) - 1e-18:
                break
        else:
            return placed
        placed[ours[a]] = low
        if theirs[b] >= 0:
            placed[theirs[b]] = high
        totals[high] -= mine[a] - other[b]
        totals[low] += mine[a] - other[b]
    return placed


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard and slot (gapless from 0 in its shard) of every row.

    Size is the text's UTF-8 bytes plus 1, tokens are words between blanks. A null text counts as empty, a null doc_id is
    a value like any other, repeated rows are placed each on its own, and an empty table gives an empty result. Other
    columns of docs, whatever their names, are ignored. Equal texts share a shard, unless they make up more of the bytes, tokens or rows than
    one shard's share; the rows of such a text are dealt by their ids and places in the input, so null or repeated ids don't keep them
    together. A very long text is read by built-in functions alone.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col("doc_id"),
            (n_bytes(text) + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("g"),
            # written with the rows, so the same wherever they are read again; parts rows that share both id and text
            F.monotonically_increasing_id().alias("nth_row"),
        )
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    of_all = {d: max(1, total[d] or 0) for d in _DIMENSIONS}
    share = F.greatest(*(F.col(d) / F.lit(float(of_all[d])) for d in _DIMENSIONS))
    groups = rows.groupBy("g").agg(*sums).withColumn("share", share)
    large = groups.filter(F.col("share") > 1.0 / CELLS).collect()  # at most 3 * CELLS rows
    hot = [r["g"] for r in large if r["share"] > 1.0 / shards]  # at most 3 * shards
    kinds = spark.createDataFrame([(r["g"], r["g"] in set(hot)) for r in large], "g long, is_hot boolean")
    marked = rows.join(F.broadcast(kinds), "g", "left").select(
        *rows.columns,
        F.when(F.col("is_hot").isNull(), F.pmod("g", F.lit(CELLS))).otherwise(F.col("g")).alias("unit"),
        F.when(F.col("is_hot").isNull(), F.lit(-2))
        .when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "nth_row", F.lit(1)), F.lit(HOT_PARTS)))
        .otherwise(F.lit(-1))
        .cast("int")
        .alias("part"),
    )
    units = marked.groupBy("unit", "part").agg(*sums).collect()  # at most 4 * CELLS + 3 * shards * HOT_PARTS rows
    units.sort(key=lambda r: (r["part"], r["unit"]))
    vectors = np.array([[r[d] / of_all[d] for d in _DIMENSIONS] for r in units]).reshape(len(units), 3)
    chosen = even_out(vectors, place(vectors, shards), shards)
    placed = [(r["unit"], r["part"], int(s)) for r, s in zip(units, chosen, strict=True)]
    placement = spark.createDataFrame(placed, "unit long, part int, shard int")
    buckets = max(1, math.ceil((total["rows"] or 0) / SLOT_ROWS))
    sharded = marked.join(F.broadcast(placement), ["unit", "part"]).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "nth_row", F.lit(2)), F.lit(buckets)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sharded.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        sharded.withColumn("nth", F.row_number().over(within))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )

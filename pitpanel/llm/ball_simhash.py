"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all its variants, the fingerprints within half of the radius. Two fingerprints within the radius
share a variant that lies halfway between them, and two that share one are within the radius, so links are read off the
variants without pairs: a variant's group, which holds no more fingerprints than a ball has variants, is tied to its least one.
Edges are deduplicated and verified by their differing bits, and minimum labels give components.

Copies are one fingerprint from the start. A fingerprint that holds more than a fixed share of all rows takes its component from a
broadcast of bounded size, the others from a join by fingerprint, so no key gathers many rows in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, evaluated_once, text_bytes
from .near_dedup import components

SHINGLE, BITS, SEED = 3, 64, 42
#: Differing bits of linked fingerprints at most; even, as half of it is the radius of the variants.
RADIUS = 2
#: A fingerprint with more than one in so many rows is common; there are fewer than this many of them.
COMMON = 4096
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `width` lower-cased words, repeats included; of fewer words, one of the whole sequence."""
    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False))
    return np.fromiter(found, np.uint64, len(words) - width + 1)


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes; 0 without words."""
    hashed = [shingle_hashes(t, width) for t in texts]
    counts = np.fromiter(map(len, hashed), np.int64, len(hashed))
    every = np.concatenate([*hashed, np.zeros(0, np.uint64)])
    ones = np.zeros((len(texts), BITS), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for at in range(0, len(every), COUNTED):
        part, own = every[at : at + COUNTED], owner[at : at + COUNTED]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _marker(width: int):
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [text_bytes(t) for t in batch]
            parts = [fingerprints(texts[a:b], width) for a, b in chunks(texts)]
            yield pd.Series(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))

    return mark


def ball(radius: int, bits: int = BITS) -> list[int]:
    """What the fingerprints within `radius` differ in, as signed longs."""
    masks = [sum(1 << b for b in picked) for k in range(radius + 1) for picked in itertools.combinations(range(bits), k)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (one long column) that tie together all within `radius` bits of each other."""
    if radius % 2:
        raise ValueError("the radius must be even")
    own = fingerprints.toDF("a").distinct()
    around = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])).alias("differs")
    variants = own.select("a", around).select("a", F.col("a").bitwiseXOR(F.col("differs")).alias("variant"))
    least = F.min("a").over(Window.partitionBy("variant"))
    met = variants.select("a", least.alias("b")).filter("a <> b").distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def simhash_groups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable, itself included) of every row.

    Null and empty texts, or those without words, have fingerprint zero and are linked like any other. Rows with a null doc_id link others too;
    their component_id is that of the rows with an id, null if there are none. Rows that repeat a doc_id with several texts are linked as
    their texts are, each for itself; tied copies share the smallest doc_id. An empty table stays empty; other columns, whatever their
    names, are ignored. A very long text is hashed whole in one task, with about 100 bytes of memory for each word.
    """
    with Scratch(docs.sparkSession) as scratch:
        mark = evaluated_once(_marker(width), "long", F.col("text").cast("string"))
        rows = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("node")))
        classes = scratch.table(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
        labels = components(scratch.table(links(classes.select("node"), radius)), scratch)
        labelled = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # A component's least doc_id is found over classes, so copies don't count.
        least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
        named = scratch.table(labelled.join(least, "label").select("node", "rows", "component_id"))
        total = named.agg(F.sum("rows").alias("n")).first()["n"] or 0
        scratch.keep(rows, named)
    is_common = F.col("rows") * COMMON > total
    common = named.filter(is_common).select("node", "component_id", F.lit(True).alias("is_common"))
    marked = rows.join(F.broadcast(common), "node", "left")
    rest = marked.filter("is_common is null").select("node", "doc_id").join(named.filter(~is_common), "node")
    out = ("doc_id", hex_digits(F.col("node")).alias("fingerprint"), "component_id")
    return marked.filter("is_common").select(*out).union(rest.select(*out))

"""Ranked lexical search of whole documents for every item of a query table, by presence masks.

One pass turns documents into postings of the items' terms, a table that also gives N, L and document frequencies. A second pass goes
over this table in chunks of documents. A chunk holds a bitmap of documents for each term; for an item, the bitmaps of its terms
laid together give each document's mask of matched terms, and documents are grouped by mask. What a mask can score at most
follows from the best that each of its terms reaches in the chunk. Distinct masks are evaluated by descending maximum, document
by document, until the maximum falls below the item's worst kept score, which goes with the task from chunk to chunk; ties are still
evaluated, so nothing is lost. Each task gives out its best documents of each item, and two rounds of ranking merge them.

Terms of the items are broadcast in parts of bounded size; further parts take further passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, evaluated_once, text_bytes, word_codes
from .decontaminate import _TABLE, _WORDS

#: Distinct terms of items that one pass takes, about 10 MB of memory in each worker. An item of more terms has a pass for itself.
PART_TERMS = 1 << 16
#: Documents that a chunk holds bitmaps and masks of.
CHUNK_DOCS = 4096
#: Groups of tasks whose best documents are ranked apart before all are.
GROUPS = 64
_MASK_BITS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of items; rows of one item_id, or of none, make one item together."""
    lower = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    term = F.explode(F.regexp_extract_all(lower, F.lit(_WORDS), 0)).alias("term")
    return items.select(F.col("item_id").cast("long").alias("item_id"), term).distinct()


def _postings_maker(number: Broadcast) -> Callable:
    def postings(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = number.value
        for batch in batches:
            texts, rows = [text_bytes(t) for t in batch], []
            for a, b in chunks(texts):
                words = [t.translate(_TABLE).split() for t in texts[a:b]]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                codes, unique = word_codes([w for ws in words for w in ws])
                term = np.fromiter((known.get(w, -1) for w in unique), np.int64, len(unique))[codes] if len(unique) else codes
                use = term >= 0
                doc = np.repeat(np.arange(len(words)), lengths)[use]
                pair, tf = np.unique(doc * len(known) + term[use], return_counts=True)
                edges = np.searchsorted(pair, np.arange(len(words) + 1) * len(known))
                term = (pair % max(1, len(known))).astype(np.int32)
                rows += [(int(n), term[x:y], tf[x:y]) for n, x, y in zip(lengths, edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["n", "terms", "tf"])

    return postings


def contributions(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(10 ** 9 * tf) div (1000 * tf + 8 * m) of terms found tf times in documents of n terms, in exact integers."""
    if len(n) and int(n.max()) * 90 * docs >= 1 << 63:
        m = np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * docs // max(1, terms)
    return 10**9 * tf // (1000 * tf + 8 * m)


class Chunk:
    """Postings of some documents, by document, and a bitmap of documents for each of their terms."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, docs: int, length: int):
        self.ids, self.known, self.docs = ids, known, len(ids)
        self.ends = np.append(0, np.cumsum(sizes))
        owner = np.repeat(np.arange(self.docs), sizes)
        self.terms, at = np.unique(terms, return_inverse=True)
        self.at, self.gain = at, contributions(tf.astype(np.int64), np.repeat(n, sizes), docs, length)
        self.best = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.best, at, self.gain)
        self.bitmaps = np.zeros((len(self.terms), -(-self.docs // 8)), np.uint8)
        np.add.at(self.bitmaps, (at, owner >> 3), (128 >> (owner & 7)).astype(np.uint8))

    def masks(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For terms at these places: which documents hold any, the number of the mask of each, and the masks (rows)."""
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bitmaps[own], axis=0), count=self.docs))
        present = np.unpackbits(self.bitmaps[own], axis=1, count=self.docs)[:, some]
        group, first = np.zeros(len(some), np.uint64), np.zeros(0, np.int64)
        for a in range(0, len(own), _MASK_BITS):
            slab = present[a : a + _MASK_BITS]
            bits = np.zeros(len(some), np.uint64)
            for k in range(len(slab)):
                bits |= slab[k].astype(np.uint64) << np.uint64(k)
            _, first, inverse = np.unique(group << np.uint64(_MASK_BITS) | bits, return_index=True, return_inverse=True)
            group = inverse.astype(np.uint64)
        return some, group.astype(np.int64), present[:, first].T

    def scores(self, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of documents under weights of the chunk's terms."""
        sizes = self.ends[which + 1] - self.ends[which]
        place = np.repeat(self.ends[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros(len(which), np.int64)
        np.add.at(out, np.repeat(np.arange(len(which)), sizes), weight[self.at[place]] * self.gain[place])
        return out


class Best:
    """The best documents of one item so far: descending scores, ties by ascending id, those without an id last."""

    def __init__(self, limit: int):
        self.limit, self.score = limit, np.zeros(0, np.int64)
        self.id, self.known = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """What a further document has to score at least."""
        return max(1, int(self.score[-1])) if len(self.score) == self.limit else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        use = score >= self.floor
        score, ids, known = (np.concatenate([x, y[use]]) for x, y in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.limit]
        self.score, self.id, self.known = score[order], ids[order], known[order]

    def search(self, chunk: Chunk, terms: np.ndarray, weights: np.ndarray) -> int:
        """Takes in a chunk's documents for the terms of the item; returns how many were evaluated."""
        own = np.searchsorted(chunk.terms, terms)
        found = own < len(chunk.terms)
        found[found] = chunk.terms[own[found]] == terms[found]
        own, weights = own[found], weights[found]
        reach = weights * chunk.best[own]
        if not len(own) or int(reach.sum()) < self.floor:
            return 0
        docs, group, masks = chunk.masks(own)
        most = masks.astype(np.int64) @ reach
        order = np.argsort(-most, kind="stable")
        by_mask = np.argsort(group, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(group, minlength=len(most))))
        weight = np.zeros(len(chunk.terms), np.int64)
        weight[own] = weights
        at, step, seen = 0, self.limit, 0
        while at < len(order) and most[order[at]] >= self.floor:
            these = order[at : at + step]
            these = these[most[these] >= self.floor]
            which = docs[np.concatenate([by_mask[ends[g] : ends[g + 1]] for g in these])]
            self.add(chunk.scores(which, weight), chunk.ids[which], chunk.known[which])
            at, step, seen = at + len(these), 2 * step, seen + len(which)
        return seen


def _searcher(items: Broadcast, docs: int, length: int, limit: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = items.value
        best = [Best(limit) for _ in numbered]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                rows = batch.slice(at, CHUNK_DOCS)
                ids, known, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "known", "n"))
                sizes = rows.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                terms, tf = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tf"))
                chunk = Chunk(ids, known, n, sizes, terms, tf, docs, length)
                for own, (_, item, weights) in zip(best, numbered, strict=True):
                    own.search(chunk, item, weights)
        rows = [(item, int(i) if k else None, int(s)) for own, (item, *_) in zip(best, numbered, strict=True) for s, i, k in zip(own.score, own.id, own.known, strict=True)]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", "score"])

    return search


def _ranked(found: DataFrame, limit: int, *within: str | Column) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def ranked_search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `limit` highest-scoring rows of docs with a score above 0, all if fewer.

    Equal scores rank by ascending doc_id, null ones last; rows that repeat a doc_id rank each for itself. Null and empty texts, or those
    without terms, are found by nothing. Items without terms find nothing; rows of items that share an item_id, null among them, are
    one item with the terms of all. Without items or documents there are no rows; other columns, whatever their names, are ignored. A
    very long text is split into its terms in one task, with about 100 bytes of memory for each.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    with Scratch(spark) as scratch:
        terms = scratch.table(item_terms(items))
        parts = max(1, -(-terms.count() // PART_TERMS))
        part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        found = []
        for k in range(parts):
            own = terms.filter(part == k).orderBy("item_id", "term").collect()
            words = sorted({r["term"] for r in own})
            number = context.broadcast({text_bytes(w): i for i, w in enumerate(words)})
            make = evaluated_once(_postings_maker(number), "n long, terms array<int>, tf array<long>", F.col("text").cast("string"))
            ids = F.col("doc_id").cast("long")
            rows = docs.select(F.coalesce(ids, F.lit(0).cast("long")).alias("doc_id"), ids.isNotNull().alias("known"), make.alias("p"))
            rows = scratch.table(rows.select("doc_id", "known", "p.*"))
            whole = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
            held = {r[0]: r[1] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
            weight = np.zeros(len(words), np.int64)
            for t, df in held.items():
                weight[t] = math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * df + 1)))
            by_item: dict[int | None, list[int]] = {}
            place = {w: i for i, w in enumerate(words)}
            for r in own:
                if weight[place[r["term"]]] > 0:
                    by_item.setdefault(r["item_id"], []).append(place[r["term"]])
            numbered = [(item, np.sort(np.array(own_terms)), weight[np.sort(np.array(own_terms))]) for item, own_terms in by_item.items()]
            searcher = _searcher(context.broadcast(numbered), whole["docs"], whole["length"], limit)
            best = rows.filter("size(terms) > 0").mapInArrow(searcher, "item_id long, doc_id long, score long")
            best = best.withColumn("task", F.spark_partition_id() % GROUPS)
            found.append(scratch.table(_ranked(best, limit, "item_id", "task").drop("task", "rank")))
            scratch.drop(rows)
        every = found[0]
        for own in found[1:]:
            every = every.union(own)
        scratch.keep(*found)
    return _ranked(every, limit, "item_id").select("item_id", "rank", "doc_id", "score")

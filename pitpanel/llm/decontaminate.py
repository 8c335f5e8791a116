"""Wu-Manber search of documents for passages of benchmark items, with words as the alphabet.

Patterns of one length share a table. Blocks are pairs of words (a single word for patterns of one word): the shift
table tells how far the search may move on when a block ends at the current word, so most words of a document
are never looked at. Where the shift is 0, the bucket of the window's hash, taken from its end, holds the patterns to test,
and each is compared with the text directly. Words are numbered, tables are sorted arrays, and all documents of a batch
are searched side by side, in lanes.

Tables are built once, on the driver, from parts of the benchmark of bounded size, and broadcast. A benchmark of several parts is
searched in as many passes, one after the other: each writes what it found, by text, before its broadcast goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, evaluated_once, mix, n_bytes, split_by_ids, text_bytes, unused

WINDOW = 13
#: Benchmark text that one set of tables may hold, about 9 MB of memory for each MB in each worker and some 40 on the driver.
MAX_PART_BYTES = 8 << 20
#: Windows of a document that one lane of the search takes.
LANE = 512
_U64 = np.uint64
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and characters beyond ASCII."""
    return text_bytes(text).translate(_TABLE).split()


def _backward_hash(windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), _U64)
    for k in range(windows.shape[1] - 1, -1, -1):
        out = mix(out * _U64(0x9E3779B97F4A7C15) + windows[:, k].astype(_U64))
    return out


class WuManber:
    """Tables for patterns of one length, rows of word numbers; items tells whose pattern each is."""

    def __init__(self, patterns: np.ndarray, items: np.ndarray, words: int):
        self.length, self.words = patterns.shape[1], words + 1
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.blocks, self.moves = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for move in range(self.default):  # ascending, so the first that a block gets is its least
            end = self.length - move
            own = np.setdiff1d(self._keys(patterns[:, end - self.block : end]), self.blocks)
            order = np.argsort(both := np.concatenate([self.blocks, own]))
            self.moves = np.concatenate([self.moves, np.full(len(own), move, np.uint8)])[order]
            self.blocks = both[order]
        hashes = _backward_hash(patterns)
        order = np.lexsort((items, hashes))
        hashes, patterns, self.items = hashes[order], patterns[order], items[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (patterns[1:] != patterns[:-1]).any(axis=1))
        self.first = np.append(np.flatnonzero(new), len(patterns))  # of each distinct pattern among the items
        self.hashes, self.patterns = hashes[new], patterns[new]

    def _keys(self, block: np.ndarray) -> np.ndarray:
        """One number for each block of words (rows)."""
        return block[:, 0].astype(np.int64) * self.words + block[:, 1] if self.block == 2 else block[:, 0].astype(np.int64)

    def candidates(self, numbers: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Starts of windows whose last block ends some pattern; each lane goes from its `at` to before its `stop`."""
        found = []
        while len(at):
            end = at + self.length
            key = self._keys(np.stack([numbers[end - k] for k in range(self.block, 0, -1)], axis=1))
            place = np.minimum(np.searchsorted(self.blocks, key), len(self.blocks) - 1)
            move = np.where(self.blocks[place] == key, self.moves[place], self.default)
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence and the pattern, in documents of these word counts laid end to end."""
        windows = np.maximum(lengths - self.length + 1, 0)
        lanes = -(-windows // LANE)
        begins = np.cumsum(lengths) - lengths
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(begins, lanes) + nth * LANE
        start = self.candidates(numbers, at, np.minimum(at + LANE, np.repeat(begins + windows, lanes)))
        seen = numbers[start[:, None] + np.arange(self.length)]
        hashes = _backward_hash(seen)
        low, high = (np.searchsorted(self.hashes, hashes, side) for side in ("left", "right"))
        size = high - low
        which = np.repeat(np.arange(len(start)), size)
        pattern = np.repeat(low - np.cumsum(size) + size, size) + np.arange(len(which))
        same = (seen[which] == self.patterns[pattern]).all(axis=1)
        return start[which[same]], pattern[same]


class Tables:
    """All that a part of the benchmark is searched by: word numbers (from 1) and a WuManber for each pattern length."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32)
                by_length.setdefault(min(window, len(words)), []).append((numbers, item))
        self.searchers = []
        for length, own in sorted(by_length.items()):
            patterns = [np.lib.stride_tricks.sliding_window_view(numbers, length) for numbers, _ in own]
            ids = np.repeat(np.array([item for _, item in own], np.int64), [len(p) for p in patterns])
            self.searchers.append(WuManber(np.concatenate(patterns), ids, len(self.number)))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[dict[str, int]], list[int]]]:
        """For each text its number of words, the merged spans [start, end) of hit words, and the items found."""
        words = [t.translate(_TABLE).split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = self.number.get
        numbers = np.fromiter((number(w, 0) for ws in words for w in ws), np.int64, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        edge, pairs = np.zeros(len(numbers) + 1, np.int64), []
        filled = np.flatnonzero(lengths)
        for own in self.searchers:
            start, pattern = own.search(numbers, lengths)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + own.length, -1)
            size = own.first[pattern + 1] - own.first[pattern]
            item = own.items[np.repeat(own.first[pattern] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            doc = filled[np.searchsorted(begins[filled], start, "right") - 1]
            pairs.append(np.stack([np.repeat(doc, size), item], axis=1))
        out = [(int(n), [], []) for n in lengths]
        if pairs:
            for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist():
                out[doc][2].append(item)
        hit = np.cumsum(edge[:-1]) > 0
        begin = np.zeros(len(hit), bool)
        begin[begins[filled]] = True
        from_ = np.flatnonzero(hit & (begin | ~np.append(False, hit[:-1])))
        to = np.flatnonzero(hit & (np.append(begin[1:], True) | ~np.append(hit[1:], False))) + 1
        for a, b in zip(from_.tolist(), to.tolist(), strict=True):
            doc = filled[np.searchsorted(begins[filled], a, "right") - 1]
            out[doc][1].append({"start": a - int(begins[doc]), "end": b - int(begins[doc])})
        return out


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size; one part at a time is on the driver. A larger item is a part of its own."""
    part, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropna()
    whole = items.agg(F.sum(n_bytes(F.col("text"))).alias("n")).first()["n"] or 0
    for item, text in items.collect() if whole <= MAX_PART_BYTES else items.toLocalIterator():
        if part and size + len(text.encode("utf-8", "surrogatepass")) > MAX_PART_BYTES:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += len(text.encode("utf-8", "surrogatepass"))
    yield part


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _searcher(tables: Broadcast) -> Callable:
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [text_bytes(t) for t in batch]
            rows = [row for a, b in chunks(texts) for row in tables.value.find(texts[a:b])]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return search


def _merged(spans: Column) -> Column:
    """Spans in order without overlaps."""
    last = lambda done: F.element_at(done, -1)
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")
    longer = lambda done, s: F.concat(
        F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end")))
    )
    join = lambda done, s: (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"])
    return F.aggregate(F.array_sort(spans), start, lambda done, s: F.when(join(done, s), longer(done, s)).otherwise(F.concat(done, F.array(s))))


def _with_hits(docs: DataFrame, benchmark: DataFrame, window: int, hits: str) -> DataFrame:
    """docs with a column, named as `hits` says, of n_words, the spans of words hit by a benchmark window, and the items found."""
    context, text = docs.sparkSession.sparkContext, F.col("text").cast("string")
    parts = _parts(benchmark)
    part, following = next(parts), next(parts, None)
    search = lambda tables: evaluated_once(_searcher(tables), _FOUND, text)
    if following is None:
        return docs.withColumn(hits, search(context.broadcast(Tables(part, window))))
    key = unused("text_key", docs.columns)
    with Scratch(docs.sparkSession) as scratch:
        found = []
        while part is not None:
            tables = context.broadcast(Tables(part, window))
            own = docs.select(F.md5(text.cast("binary")).alias(key), search(tables).alias("found")).filter("size(found.items) > 0")
            found.append(scratch.table(own.dropDuplicates([key])))
            tables.destroy()
            part, following = following, next(parts, None)
        every = found[0]
        for own in found[1:]:
            every = every.union(own)
        lists = every.groupBy(key).agg(F.flatten(F.collect_list("found.spans")).alias("spans"), F.flatten(F.collect_list("found.items")).alias("items"))
        merged = scratch.table(lists.select(key, _merged(F.col("spans")).alias("spans"), F.array_distinct("items").alias("items")))
        scratch.keep(merged)
    n_words = F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")
    spans, items = unused("spans", docs.columns), unused("items", docs.columns)
    # Most texts have no hit, so only those that may have one are shuffled; the others get empty lists where they are.
    keyed = docs.withColumn(key, F.md5(text.cast("binary")))
    doubtful, sure = split_by_ids(keyed, F.col(key), merged.select(key), merged.count())
    joined = doubtful.join(merged.toDF(key, spans, items), key, "left")
    none = lambda c: F.array().cast(dict(joined.dtypes)[c])
    sure = sure.withColumns({spans: none(spans), items: none(items)})
    every = joined.withColumns({c: F.coalesce(F.col(c), none(c)) for c in (spans, items)}).select(*sure.columns).union(sure)
    return every.select(*docs.columns, F.struct(n_words.alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items")).alias(hits))


def _n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _contaminated(hits: Column) -> Column:
    return (_n_hit(hits) > 0) & (_n_hit(hits) * 20 >= hits["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids found), contaminated and spans of every row.

    Documents without words (null or empty texts) have no hits. Items with a null id or text, or without words, have no
    windows; an empty benchmark hits nothing, an empty table of documents stays empty. Repeated rows of either table don't change
    what is found; null and repeated doc_ids are rows like any other; other columns are ignored. A very long text is searched
    whole in one task, with about 100 bytes of memory for each word.
    """
    hits = F.col("hits")
    return _with_hits(docs.select("doc_id", "text"), benchmark, window, "hits").select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        _n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        hits["items"].alias("items"),
        _contaminated(hits).alias("contaminated"),
        hits["spans"].alias("spans"),
    )


def items_digest(items: Column) -> Column:
    """sha256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs, whatever their names.

    Null and empty texts stay, as do all rows where the benchmark has no words; see contamination for other odd input.
    """
    hits = unused("hits", docs.columns)
    return _with_hits(docs, benchmark, window, hits).filter(~_contaminated(F.col(hits))).select(*docs.columns)

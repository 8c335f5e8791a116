"""Phrases whose words belong together, by best-first branch and bound over prefix counts.

A phrase scores floor(1000 * a * n / (l * r)) at its worst cut. As r is at least a, no phrase that begins with a prefix counted l times scores more than
floor(1000 * n / l), and the first word, the most frequent prefix, gives the bound of all that grows from it. So the frontier is the
frequent words, the rarest ones, whose bounds are highest, first. Each round expands a band of them: prefixes grow word by word, and
only prefixes that are frequent themselves grow on. Then the counts of the other parts of those candidates are fetched whose last
cut still allows enough, and their neighbours, which tell whether a longer candidate occurs as often. Rounds go on until no
word left in the frontier has a bound that reaches its language's last kept score; a bound that equals it is expanded, so ties are settled.

Texts are split once, into blocks of numbered words that every later pass reads. What the passes look for goes out as bitmaps of
hashes, of bounded size, which let some more phrases through but none escape; Spark counts phrases exactly, by their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _MULT, BITS_PER_ID, MAX_BITS, Scratch, batches_of, chunks, mix, word_codes, word_hashes

LEAST, LONGEST, LIMIT = 100, 5, 2000
#: Words of a block, and of all blocks that a task has open (one for each language).
BLOCK_WORDS, OPEN_WORDS = 1 << 18, 1 << 20
#: Bytes of a batch of blocks or texts, one block or two.
BATCH = "2m"
#: How blocks are written: Parquet would hold a hundred rows of them before it looks at their size, to write as to read them. So a page is one block and a
#: row group a few, whatever a task reads.
PARQUET = {"parquet.page.row.count.limit": 1, "parquet.block.row.count.limit": 4, "parquet.enable.dictionary": False, "parquet.column.statistics.enabled": False}
#: Words of a block that two bytes can number, the end of a piece besides.
NARROW = (1 << 16) - 1
#: A round expands the words up to this many times as frequent as the rarest left.
BAND = 32
#: Shares of a language that are ranked apart before the best of all are.
SHARES = 32
_U64 = np.uint64
_CUT = b"."
_SPLIT = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes) -> list[bytes]:
    """Lower-cased words, with the word `.` wherever a piece ends."""
    return text.translate(_SPLIT).replace(_CUT, b" . ").split()


class _Open:
    """The block of a language that is being filled."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_CUT] = 0
        self.codes, self.words = [], 0

    def add(self, texts: list[bytes]) -> None:
        found = [w for t in texts for w in (*pieces(t), _CUT)]
        self.codes.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.words += len(found)

    def row(self, lang: bytes) -> tuple:
        codes, words = np.concatenate(self.codes), list(self.number)[1:]
        self.number.default_factory = None  # a cycle, which would keep the words until it is looked for
        hashes = lang_hashes(lang, np.array(words, dtype=object))
        n = int(np.count_nonzero(codes))
        return lang, n, b" ".join(words), hashes.tobytes(), codes.astype(np.uint16 if len(words) <= NARROW else np.int32).tobytes()


def lang_hashes(lang: bytes, words: np.ndarray) -> np.ndarray:
    """Hashes of words of a language."""
    own = word_hashes(np.zeros(1, np.int64), np.array([lang], dtype=object), 1)[0]
    return mix(word_hashes(np.arange(len(words)), words) ^ own)


#: A block is a row: its words joined by one space, and arrays as bytes, which go to workers as they are. Codes are places of words from 1 on, 0 ends a piece.
_BLOCKS = "lang binary, n long, words binary, hashes binary, codes binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filling: dict[bytes, _Open] = {}

    def emit(lang: bytes) -> pa.RecordBatch:
        names = [field.split()[0] for field in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in filling.pop(lang).row(lang)], names=names)

    for batch in batches:
        langs, texts = (batch.column(c).to_pylist() for c in ("lang", "text"))
        by_lang: dict[bytes, list[bytes]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for a, b in chunks(own):
                block = filling.setdefault(lang, _Open())
                block.add(own[a:b])
                if block.words >= BLOCK_WORDS:
                    yield emit(lang)
                elif sum(x.words for x in filling.values()) >= OPEN_WORDS:
                    yield emit(max(filling, key=lambda x: filling[x].words))
    for lang in list(filling):
        yield emit(lang)


class Bitmap:
    """Which hashes may be among some; its size is bounded, and beyond that it only lets more through."""

    def __init__(self, data: np.ndarray):
        self.data, self.last = data, _U64(len(data) * 8 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.last
        return (self.data[(at >> _U64(3)).astype(np.int64)] >> (at & _U64(7)).astype(np.uint8)) & 1 == 1


def phrase_hashes(langs: list[bytes], phrases: list[bytes]) -> np.ndarray:
    """The hashes that blocks give to phrases (words joined by one space) of these languages."""
    split = [p.split(b" ") for p in phrases]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in split for w in ws]
    hashed, owner = np.zeros(len(flat), _U64), np.repeat(word_codes(langs)[0] if langs else sizes, sizes)
    for code, lang in enumerate(dict.fromkeys(langs)):
        use = owner == code
        codes, unique = word_codes(list(flat[use]))
        hashed[use] = lang_hashes(lang, unique)[codes]
    out, first = np.zeros(len(split), _U64), np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        use = sizes > k
        out[use] = out[use] * _MULT + hashed[first[use] + k]
    return mix(out)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = phrase_hashes(*(batch.column(c).to_pylist() for c in ("lang", "phrase")))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], names=["h"])


def bitmap(rows: DataFrame, phrase: Column | None = None) -> Broadcast:
    """A broadcast Bitmap of the phrases (lang, phrase) of rows."""
    asked = F.col("phrase") if phrase is None else phrase
    return hash_bitmap(rows.select(F.col("lang").cast("binary").alias("lang"), asked.cast("binary").alias("phrase")).mapInArrow(_hashes, "h long"), rows.count())


def hash_bitmap(hashes: DataFrame, count: int) -> Broadcast:
    """A broadcast Bitmap of so many hashes h, of 16 MB at most."""
    bits = max(1 << 15, min(MAX_BITS, 1 << (BITS_PER_ID * max(1, count) - 1).bit_length()))
    place = F.col("h").bitwiseAND(bits - 1) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held"))
    data = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        data[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["held"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(Bitmap(data))


class _Block:
    def __init__(self, row: pa.RecordBatch):
        self.row = row
        self.hashes = np.frombuffer(row.column("hashes")[0].as_py(), _U64)
        self.codes = np.frombuffer(row.column("codes")[0].as_py(), np.uint16 if len(self.hashes) <= NARROW else np.int32).astype(np.int32) - 1

    @cached_property
    def lang(self) -> bytes:
        return self.row.column("lang")[0].as_py()

    @cached_property
    def words(self) -> np.ndarray:
        words = self.row.column("words")[0].as_py()
        return np.array(words.split(b" ") if words else [], dtype=object)

    def counts(self) -> np.ndarray:
        """How often each word is in the block."""
        return np.bincount(self.codes[self.codes >= 0], minlength=len(self.hashes))

    def flags(self, among: Bitmap) -> np.ndarray:
        """Which words may be among some; the last one, at place -1, is the end of a piece, which isn't."""
        return np.append(among(mix(self.hashes)), False)

    def starts(self, first: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
        """Places where a word flagged in `first` is followed by size - 1 words flagged in `other`."""
        at = np.flatnonzero(first[self.codes[: max(0, len(self.codes) - size + 1)]])
        for k in range(1, size):
            at = at[other[self.codes[at + k]]]
        return at

    def hashed(self, at: np.ndarray, size: int) -> np.ndarray:
        out = self.hashes[self.codes[at]]
        for k in range(1, size):
            out = out * _MULT + self.hashes[self.codes[at + k]]
        return mix(out)

    def grouped(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct phrase of `size` words at these places, and which phrase each place has."""
        group, first = self.codes[at].astype(np.int64), np.zeros(0, np.int64)
        for k in range(1, size):
            _, first, group = np.unique(group * len(self.hashes) + self.codes[at + k], return_index=True, return_inverse=True)
        return at[first], group

    def strings(self, at: np.ndarray, size: int) -> list[bytes]:
        return [b" ".join(x) for x in zip(*(self.words[self.codes[at + k]] for k in range(size)), strict=True)]


def _hashed(size: int, words: Broadcast | None, firsts: Broadcast | None, prefixes: Broadcast | None) -> Callable:
    """Counts in each block, by hash, of phrases of `size` words that begin with some words and have prefixes that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1))
                if size == 1:
                    found, n = mix(block.hashes), block.counts()
                else:
                    at = block.starts(block.flags(firsts.value), block.flags(words.value), size)
                    if prefixes is not None and len(at):
                        at = at[prefixes.value(block.hashed(at, size - 1))]
                    found, n = np.unique(block.hashed(at, size), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    return count


def _counted(size: int, words: Broadcast | None, firsts: Broadcast | None, frequent: Broadcast) -> Callable:
    """Counts in each block, by their words, of those phrases whose hashes may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1))
                if size == 1:
                    own = np.flatnonzero(frequent.value(mix(block.hashes)))
                    strings, n = block.words[own].tolist(), block.counts()[own]
                else:
                    at = block.starts(block.flags(firsts.value), block.flags(words.value), size)
                    first, group = block.grouped(at[frequent.value(block.hashed(at, size))], size)
                    strings, n = block.strings(first, size), np.bincount(group)
                arrays = [pa.array([block.lang] * len(strings), pa.binary()), pa.array(strings, pa.binary()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n"])

    return count


def _looker(sizes: range, words: Broadcast, firsts: Broadcast, asked: Broadcast) -> Callable:
    """Counts in each block of phrases that may be asked for; before and after are the one word next to all of their places, if there is one."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch.slice(i, 1))
                codes = np.append(block.codes, np.int32(-1))  # also what is before the first word, at place -1
                first, other = block.flags(firsts.value), block.flags(words.value)
                for size in sizes:
                    at = block.starts(first, other, size)
                    at = at[asked.value(block.hashed(at, size))] if len(at) else at
                    if not len(at):
                        continue
                    place, group = block.grouped(at, size)
                    arrays = [pa.array([block.lang] * len(place), pa.binary()), pa.array(block.strings(place, size), pa.binary())]
                    arrays.append(pa.array(np.bincount(group), pa.int64()))
                    for beside in (codes[at - 1], codes[at + size]):
                        low, high = np.full(len(place), len(block.hashes), np.int32), np.full(len(place), -1, np.int32)
                        np.minimum.at(low, group, beside)
                        np.maximum.at(high, group, beside)
                        only = (low == high) & (low >= 0)
                        arrays.append(pa.array([block.words[c] if one else None for c, one in zip(low, only, strict=True)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n", "before", "after"])

    return look


def _text(rows: DataFrame) -> DataFrame:
    """Columns of bytes as strings."""
    return rows.select(*[F.col(c).cast("string").alias(c) if kind == "binary" else c for c, kind in rows.dtypes])


def _first(size: int) -> Column:
    return F.substring_index("phrase", " ", size)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(n)).cast("decimal(33,0)") * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))


def _top(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows of each language with their rank; ranked in shares first, so that no task orders a whole language."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)).cast("long")).filter(F.col("rank") <= limit)
    return ranked(ranked(rows.select("*", share), "lang", "share").drop("share", "rank"), "lang")


class _Mine:
    """Blocks of a corpus, its frequent words, and what the rounds have found."""

    def __init__(self, docs: DataFrame, least: int, longest: int, limit: int, scratch: Scratch):
        self.least, self.longest, self.limit, self.scratch = least, longest, limit, scratch
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang")
        text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
        self.blocks = scratch.table(docs.select(lang, text).mapInArrow(_encode, _BLOCKS), **PARQUET)
        self.langs = scratch.table(_text(self.blocks.groupBy("lang").agg(F.sum("n").alias("n"))))
        self.words, self.any_word = self._frequent(1, None, None)
        self.best: DataFrame | None = None

    def _frequent(self, size: int, firsts: Broadcast | None, prefixes: Broadcast | None) -> tuple[DataFrame, Broadcast]:
        """lang, phrase and a of the frequent phrases, and a bitmap that they are in.

        Most phrases are rare, so they are counted by hash first; those with frequent hashes are then counted by their words.
        """
        words = None if size == 1 else self.any_word
        hashed = self.blocks.select("hashes", "codes").mapInArrow(_hashed(size, words, firsts, prefixes), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        hashed = self.scratch.table(hashed.filter(F.col("n") >= self.least).select("h"))
        frequent = hash_bitmap(hashed, hashed.count())
        found = _text(self.blocks.mapInArrow(_counted(size, words, firsts, frequent), "lang binary, phrase binary, n long"))
        found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= self.least)
        return self.scratch.table(found), frequent

    def frontier(self) -> DataFrame:
        """Frequent words with the bound of what grows from them, as far as it reaches the last kept score."""
        words = self.words.join(self.langs, "lang").withColumn("bound", _score(F.col("a"), F.col("n"), F.col("a"), F.col("a")))
        if self.best is None:
            return words.withColumn("last", F.lit(0).cast("long"))
        last = self.best.filter(F.col("rank") == self.limit).select("lang", F.col("score").alias("last"))
        return words.join(last, "lang", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("long"))).filter("bound >= last")

    def expand(self, low: int, high: int) -> None:
        """A round: all candidates that begin with a word of the frontier seen low to high - 1 times."""
        with ExitStack() as sent:
            self._expand(low, high, lambda x: (sent.callback(x.destroy), x)[1])

    def _expand(self, low: int, high: int, sent: Callable[[Broadcast], Broadcast]) -> None:
        """A round; it writes all that it makes, so what it hands to `sent` isn't needed any more when it ends, and executors needn't hold it."""
        table = self.scratch.table
        band = table(self.frontier().filter(F.col("a").between(low, high - 1)).select("lang", "phrase", "a", "n", "last"))
        firsts, grown, prefixes = sent(bitmap(band)), {1: self.words}, None
        for size in range(2, self.longest + 1):
            found, prefixes = self._frequent(size, firsts, prefixes)
            sent(prefixes)
            if found.isEmpty():
                break
            grown[size] = found
        if len(grown) == 1:
            return
        likely = table(self._likely(grown, band))
        asked = likely.filter(F.col("size") < self.longest).select("lang", "phrase")
        for k in range(2, self.longest):
            asked = asked.union(likely.filter(F.col("size") > k).select("lang", F.substring_index("phrase", " ", -k).alias("phrase")))
        asked = table(asked.distinct())
        sizes = range(2, min(self.longest, max(grown) + 1))
        look = _looker(sizes, self.any_word, sent(bitmap(asked, _first(1))), sent(bitmap(asked)))
        seen = _text(self.blocks.mapInArrow(look, "lang binary, phrase binary, n long, before binary, after binary"))
        one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
        looked = seen.groupBy("lang", "phrase").agg(F.sum("n").alias("a"), (one("before") | one("after")).alias("held"))
        looked = table(looked.join(asked, ["lang", "phrase"], "left_semi"))
        self._keep(likely, grown, looked)

    def _likely(self, grown: dict[int, DataFrame], band: DataFrame) -> DataFrame:
        """Candidates whose last cut, of known counts, allows a score that may be kept."""
        rows = reduce(DataFrame.union, [found.withColumn("size", F.lit(size)) for size, found in grown.items() if size > 1])
        first = band.select("lang", F.col("phrase").alias("first"), "n", "last")  # the bitmap let more through
        rows = rows.withColumn("first", _first(1)).join(first, ["lang", "first"])
        rows = rows.withColumn("left", F.expr("substring_index(phrase, ' ', size - 1)")).withColumn("right", F.substring_index("phrase", " ", -1))
        known = reduce(DataFrame.union, [found.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")) for size, found in grown.items() if size < self.longest])
        rows = rows.join(known, ["lang", "left"])
        rows = rows.join(self.words.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        return rows.filter(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")) >= F.col("last")).select("lang", "phrase", "a", "n", "size")

    def _keep(self, likely: DataFrame, grown: dict[int, DataFrame], looked: DataFrame) -> None:
        """Scores the likely candidates at all cuts, drops those that a longer one holds, and ranks the rest with those kept so far."""
        cuts = likely.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
        lefts = reduce(DataFrame.union, [found.select("lang", "phrase", "a") for size, found in grown.items() if size < self.longest])
        rights = self.words.select("lang", "phrase", "a").union(looked.select("lang", "phrase", "a"))
        rows = cuts.join(lefts.toDF("lang", "left", "l"), ["lang", "left"]).join(rights.toDF("lang", "right", "r"), ["lang", "right"])
        score = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
        worst = rows.groupBy("lang", "phrase", "a", "n", "size").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        held = looked.filter("held").select("lang", "phrase")
        kept = worst.filter(F.col("size") < self.longest).join(held, ["lang", "phrase"], "left_anti").unionByName(worst.filter(F.col("size") == self.longest))
        kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        if self.best is not None:
            kept = kept.union(self.best.drop("rank"))
        self.best = self.scratch.table(_top(kept, self.limit))

    def run(self) -> DataFrame:
        done = 0
        while True:
            low = self.frontier().filter(F.col("a") > done).agg(F.min("a").alias("a")).first()["a"]
            if low is None:
                break
            done = low * BAND - 1
            self.expand(low, low * BAND)
        if self.best is None:
            empty = "lang string, phrase string, a long, l long, r long, n long, score long, rank long"
            self.best = self.scratch.table(self.blocks.sparkSession.createDataFrame([], empty))
        self.any_word.destroy()
        return self.best


def mine_collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `limit` phrases of 2 to `longest` words.

    Phrases seen `least` times or more count, by score, then a, both descending, then phrase in byte order; those that a longer candidate
    holds and that occurs as often are dropped. Ties are settled by that order, so the limit is met exactly. Null and empty texts have
    no words, documents of a null lang are those of `und`, rows count as often as they are repeated, and an empty table has no phrases;
    doc_ids and other columns are ignored. Texts are split in parts of 1 MB or whole, with about 100 bytes of memory a word.
    """
    with Scratch(docs.sparkSession) as scratch, batches_of(docs.sparkSession, BATCH):
        best = _Mine(docs, least, longest, limit, scratch).run()
        scratch.keep(best)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

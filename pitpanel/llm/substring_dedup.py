"""Removal of word windows that an earlier document holds, with a count-min prefilter.

Documents are dealt into blocks of fixed size. Pass one: every block makes a partial count-min sketch of its distinct windows,
cut into slices by window hash; the slices of all blocks are merged, and each block learns which of its cells two or more
blocks hold. Pass two: a block sends only the windows for which every row of the sketch says so (a count-min sketch never
underestimates, so no window of two blocks is lost), and Spark groups these exactly, as rows of two hash lanes, the block's
least doc_id and the window's place. Windows of one block alone are settled inside it. Each window goes out at most once per
block, however many documents of the block hold it, and groups of many blocks are parted, so a passage shared by a third of all
documents makes no large group.
Nothing is broadcast or collected, and what a task holds doesn't grow with the corpus: a block, a slice, or rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_count, chunks, corpus_bytes, inside, mix, restored, window_hashes, with_block, word_codes, word_hashes

WINDOW = 13
DEPTH = 2
#: Sketch cells of one row for each window that is expected.
CELLS_PER_WINDOW = 4
#: Cells of a slice, a byte each in a task's memory, and slices at most, so that messages between blocks and slices stay few.
#: Together they hold the sketch of about 5 TB of text; beyond that it gets more crowded, passes more windows on and still loses
#: none. On executors with more memory SLICE_CELLS is the parameter to raise.
SLICE_CELLS, MAX_SLICES = 1 << 26, 1 << 16
#: Cells of a slice that are counted at a time.
PART_CELLS = 1 << 22
#: Blocks whose rows of one window are compared in one group, at most; groups of one window then meet by their least doc_ids.
GROUP_BLOCKS = 1 << 16
_U64 = np.uint64
_SALTS = np.arange(1, DEPTH + 1, dtype=_U64) * _U64(0xA24BAED4963EE407)


def sketch_shape(total_bytes: int) -> tuple[int, int]:
    """Slices, and cells of a row in each slice. Natural text has under a word for every five bytes."""
    cells = max(1024, CELLS_PER_WINDOW * total_bytes // 5)
    slices = min(MAX_SLICES, -(-cells // SLICE_CELLS))
    return slices, min(SLICE_CELLS, -(-cells // slices))


class _Block:
    """The windows of one block: hash pairs of distinct windows with the least doc_id, and where windows start."""

    def __init__(self, rows: pa.Table, window: int, slices: int):
        self.window, self.slices = window, slices
        self.known, ids = rows["known"].to_pylist(), rows["doc_id"].to_numpy()
        self.whole = [t or b"" for t in rows["text"].to_pylist()]
        self.texts = [t if k else b"" for t, k in zip(self.whole, self.known, strict=True)]  # rows without an id take no part
        lows, highs, docs = [], [], []
        for a, b in chunks(self.texts):
            low, high, lengths = self.hashes(a, b)
            docs.append(np.repeat(ids[a:b], np.maximum(lengths - window + 1, 0)))
            lows.append(low)
            highs.append(high)
        low, high, self.doc = (
            np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((lows, _U64), (highs, _U64), (docs, np.int64))
        )
        order, new = _grouped(low, high)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.first_low, self.first_high = low[order[first]], high[order[first]]
        self.first_doc = np.minimum.reduceat(self.doc[order], first) if len(first) else np.zeros(0, np.int64)
        # Slices are ranges of hashes, so the distinct windows of a slice lie side by side.
        edges = np.array([-(-(k << 64) // slices) for k in range(slices)], dtype=_U64)
        self.bounds = np.append(np.searchsorted(self.first_low, edges), len(first))

    def hashes(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two lanes of hashes of the windows of texts a to b, and the numbers of words."""
        words = [t.split() for t in self.texts[a:b]]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = inside(lengths, self.window)
        codes, unique = word_codes([w for ws in words for w in ws])
        return *(window_hashes(word_hashes(codes, unique, lane), self.window)[starts] for lane in (0, 1)), lengths

    def cells(self, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """slice, row of the sketch, distinct cells in order, and which windows of the slice each cell holds (inverse)."""
        for k in np.flatnonzero(np.diff(self.bounds)):
            a, b = self.bounds[k], self.bounds[k + 1]
            for row in range(DEPTH):
                cell = mix(self.first_low[a:b] + _SALTS[row]) % _U64(width)
                yield int(k), row, *np.unique(cell.astype(np.uint32), return_inverse=True)

    def repeated(self, answers: pa.Table, width: int) -> np.ndarray:
        """Indices of those distinct windows that every row of the merged sketch finds in two blocks or more."""
        said = zip(answers["slice"].to_pylist(), answers["row"].to_pylist(), answers["data"].to_pylist(), strict=True)
        known = {(k, row): data for k, row, data in said}
        out: list[np.ndarray] = []
        for k, row, cells, inverse in self.cells(width):
            bits = np.unpackbits(np.frombuffer(known[k, row], np.uint8), count=len(cells)).astype(bool)[inverse]
            every = bits if row == 0 else every & bits  # noqa: F821
            if row == DEPTH - 1:
                out.append(self.bounds[k] + np.flatnonzero(every))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _grouped(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal pairs side by side, and where a new pair begins in it."""
    order = np.argsort(low)
    same = low[order][1:] == low[order][:-1]
    if (same & (high[order][1:] != high[order][:-1])).any():  # one lane alone doesn't tell them apart
        order = np.lexsort((high, low))
        same = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
    return order, np.append(np.ones(min(1, len(order)), bool), ~same)


def pack(cells: np.ndarray) -> bytes:
    """Ascending cells as Rice-coded gaps: low bits as they are, the rest in unary."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    low = max(0, int(cells[-1]) // len(cells)).bit_length() - 1
    low = max(0, low)
    ends = np.cumsum((gaps >> low) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    plain = ((gaps[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    head = np.array([len(cells), low, len(unary)], np.uint32)
    return head.tobytes() + np.packbits(unary).tobytes() + np.packbits(plain.ravel()).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, low, bits = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    size = -(-bits // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 12), count=bits))
    gaps = (np.diff(ends, prepend=-1) - 1) << low
    if low:
        plain = np.unpackbits(np.frombuffer(data, np.uint8, offset=12 + size), count=n * low).reshape(n, low)
        gaps += plain.astype(np.int64) @ (1 << np.arange(low))
    return np.cumsum(gaps)


_BLANKS = b" \t\n\r\x0b\x0c"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def _joined(text: bytes, words: list[bytes], stays: np.ndarray | None) -> bytes:
    """The words that stay, joined by one space."""
    return b" ".join(words if stays is None else [w for w, s in zip(words, stays, strict=True) if s])


def _cut(text: bytes, words: list[bytes], stays: np.ndarray | None) -> bytes:
    """The text without the words that go and the blanks after them; the text itself if none goes."""
    return text if stays is None else b"".join(m[0] for m, s in zip(_WORD.finditer(text), stays, strict=True) if s).rstrip(_BLANKS)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A word goes if it lies in a window whose words also start in a document with a smaller doc_id; the input alone decides,
    not what is left of it. Null and empty texts have no words, rows with a null doc_id keep all their words and take none
    from others, repeated rows of a doc_id take nothing from each other, and an empty table stays empty. Other columns
    are ignored. A text is handled whole in one task, with about 60 bytes of memory for each word.
    """
    return restored(_stripped(docs, window, (), _joined).withColumnRenamed("out", "kept"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with each text cut down to what stays, and n_chars, if there is one, counted anew; see remove_repeats for odd input.

    All rows stay, those without words or id as they are (a null text stays null), and so do all columns, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = _stripped(docs, window, others, _cut)
    names = {c: f"_carried_{i}" for i, c in enumerate(others)}
    columns = {"doc_id": F.when(F.col("known"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType), "text": F.col("out")}
    columns |= {c: F.col(n) for c, n in names.items()}
    if "n_chars" in columns:
        recounted = F.length("out").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, recounted).otherwise(columns["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def _stripped(docs: DataFrame, window: int, carry: Sequence[str], output: Callable[..., bytes]) -> DataFrame:
    """doc_id and known (see with_block), n_words, n_removed, out and the carried columns under other names."""
    total = corpus_bytes(docs)
    slices, width = sketch_shape(total)
    dealt = with_block(docs, block_count(total), carry).withColumn("text", F.col("text").cast("binary"))
    carried = [c for c in dealt.columns if c.startswith("_carried_")]
    bare = dealt.select("doc_id", "known", "text", "block", *carried).groupBy("block")

    def sketch(rows: pa.Table) -> pa.Table:
        block, own = rows["block"][0].as_py(), _Block(rows, window, slices)
        found = [(k, row, block, pack(cells)) for k, row, cells, _ in own.cells(width)]
        return _table(found, slice=pa.int32(), row=pa.int32(), block=pa.int32(), data=pa.binary())

    def merge(rows: pa.Table) -> pa.Table:
        cells = [unpack(x.as_py()).astype(np.uint32) for x in rows["data"]]
        held = [np.zeros(len(own), bool) for own in cells]
        for low in range(0, width, PART_CELLS):  # cells are in order, so a part of the slice at a time is in memory
            blocks = np.zeros(min(PART_CELLS, width - low), np.uint8)
            spans = [slice(*np.searchsorted(own, np.array([low, low + PART_CELLS], np.uint32))) for own in cells]
            places = [own[span] - np.uint32(low) for own, span in zip(cells, spans, strict=True)]
            for place in places:
                blocks[place] = np.minimum(blocks[place] + 1, 2)
            for bits, span, place in zip(held, spans, places, strict=True):
                bits[span] = blocks[place] > 1
        bits = pa.array([np.packbits(x).tobytes() for x in held], pa.binary())
        return rows.select(["block", "slice", "row"]).append_column("data", bits)

    def candidates(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return _table([], low=pa.int64(), high=pa.int64(), doc_id=pa.int64(), place=pa.int64())
        block, own = rows["block"][0].as_py(), _Block(rows, window, slices)
        pick = own.repeated(answers, width)
        lanes = {"low": own.first_low[pick].view(np.int64), "high": own.first_high[pick].view(np.int64)}
        return pa.table(lanes | {"doc_id": own.first_doc[pick], "place": (block << 32) + pick})

    def strip(rows: pa.Table, later: pa.Table) -> pa.Table:
        own = _Block(rows, window, slices) if len(rows) else None
        n_words, n_removed, out = [], [], []
        if own:
            earlier = np.zeros(len(own.first_low), bool)
            earlier[later["nth"].to_numpy()] = True
            goes = earlier[own.group] | (own.doc > own.first_doc[own.group])
        at = 0
        for whole, known, null in zip(own.whole, own.known, rows["text"].is_null().to_pylist(), strict=True) if own else ():
            words = whole.split()
            n = max(0, len(words) - window + 1) if known else 0
            hit = np.flatnonzero(goes[at : at + n])
            at += n
            stays = None
            if len(hit):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(0 if stays is None else int((~stays).sum()))
            out.append(None if null and output is _cut else output(whole, words, stays))
        counts = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "out": pa.array(out, pa.binary())}
        return pa.table({c: rows[c] for c in ("doc_id", "known")} | counts | {c: rows[c] for c in carried})

    binary = "block int, slice int, row int, data binary"
    sketched = bare.applyInArrow(sketch, "slice int, row int, block int, data binary")
    cells = sketched.groupBy("slice", "row").applyInArrow(merge, binary)
    sent = bare.cogroup(cells.groupBy("block")).applyInArrow(candidates, "low long, high long, doc_id long, place long")
    later = _sent_earlier(sent, block_count(total)).select("block", F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("nth"))
    kind = T.StructType().add("doc_id", "long").add("known", "boolean").add("n_words", "long").add("n_removed", "long")
    kind = T.StructType([*kind.add("out", "binary").fields, *[dealt.schema[c] for c in carried]])
    stripped = bare.cogroup(later.groupBy("block")).applyInArrow(strip, kind)
    return stripped.withColumn("out", F.col("out").cast("string"))


def _sent_earlier(sent: DataFrame, blocks: int) -> DataFrame:
    """The rows sent, with their block, whose window came with a smaller doc_id from any block.

    A window is sent once by each block that holds it. Where blocks are more than GROUP_BLOCKS, the rows of a window are parted by
    their block, and one row of each part, its least doc_id, meets those of the other parts; so a passage that every block holds
    makes no group of all blocks. With fewer blocks there is one part, and nothing to be met.
    """
    parts = -(-blocks // GROUP_BLOCKS)
    sent = sent.withColumn("block", F.shiftright("place", 32).cast("int"))
    if parts == 1:
        return sent.withColumn("first", F.min("doc_id").over(Window.partitionBy("low", "high"))).filter("first < doc_id")
    spread = sent.withColumn("part", F.pmod("block", F.lit(parts))).repartition("low", "high", "part")
    least = spread.groupBy("low", "high", "part").agg(F.min("doc_id").alias("least"))
    first = F.min("least").over(Window.partitionBy("low", "high"))
    return spread.join(least.select("low", "high", "part", first.alias("first")), ["low", "high", "part"]).filter("first < doc_id")


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns, strict=True)})

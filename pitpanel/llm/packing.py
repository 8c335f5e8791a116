"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are tokens. Documents longer than the longest sequence are cut into pieces. Pieces are dealt by hash into cells of
bounded size, each packed on its own: longest first, into the open bin that it leaves the least room in. When none has room, a
bin is opened with the permitted length that costs least for each token it can still get: a long sequence saves overhead but
pays more for attention, and one that the pieces left can't fill is dear. At the end every bin is cut down to
the smallest permitted length that holds what is in it.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, evaluated_once, restored

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its tokens, and the length at which attention costs as much again as all else.
OVERHEAD, ATTENTION = 16, 16_384
CELL_PIECES = 20_000


def sequence_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + capacity * (1 + capacity / attention)


def pack(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and the final capacity of each bin. lengths must descend and fit the largest.

    Of the bins that leave the least room the one opened or used last takes a piece; of equally cheap capacities the smallest is opened.
    """
    capacities = sorted(capacities)
    rising = [-n for n in lengths]
    left = np.concatenate([np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]])  # tokens from here on
    largest = capacities[-1]
    open_bins: list[list[int]] = [[] for _ in range(largest + 1)]  # by room
    mask, used = 0, []
    bins, offsets, rooms = [], [], []
    for i, n in enumerate(lengths):
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            best = None
            for c in capacities[bisect.bisect_left(capacities, n) :]:
                smaller = left[max(i + 1, bisect.bisect_left(rising, -(c - n)))]
                cost = sequence_cost(c) / max(1, n + min(c - n, int(smaller)))
                if best is None or cost < best[0]:
                    best = cost, c
            room, b = best[1], len(used)
            used.append(0)
            rooms.append(best[1])
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        open_bins[room].append(b)
        mask |= 1 << room
    return bins, offsets, [capacities[bisect.bisect_left(capacities, u)] for u in used]


@functools.cache
def _encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    """One for each worker process."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(text: Column, ranks_file: str, pattern: str) -> Column:
    """Tokens of each text, none for null, special strings being ordinary text. The file must exist on every executor."""

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks_file, pattern)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch], dtype="int64")

    return evaluated_once(lengths, "long", text.cast("string"))


def pack_documents(
    docs: DataFrame, ranks_file: str, pattern: str, capacities: Sequence[int] = CAPACITIES, cell_pieces: int = CELL_PIECES
) -> DataFrame:
    """doc_id, piece, start, n_tokens (of the piece), cell, bin (of the cell), position, offset and capacity; a row for each piece.

    Lengths are tokens of the byte-pair ranks in the file, after splitting by the pattern. A text without tokens (null or
    empty) is one piece of length 0. Null and repeated doc_ids are packed like any other row, ties go by doc_id, an empty table gives
    no bins, other columns are ignored, whatever their names. A very long text is encoded whole in one task and cut into many pieces.
    """
    largest = max(capacities)
    own = F.col("doc_id").cast("long")
    counted = checkpoint(
        docs.select(
            F.coalesce(own, F.lit(0).cast("long")).alias("doc_id"),  # pandas would make floats of integers with nulls
            own.isNotNull().alias("known"),
            F.xxhash64("text").alias("key"),
            token_lengths(F.col("text"), ranks_file, pattern).alias("tokens"),
        )
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / largest) - 1).cast("long")
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    cells = max(1, math.ceil((counted.agg(F.sum(last + 1).alias("n")).first()["n"] or 0) / cell_pieces))
    celled = pieces.select(
        "doc_id",
        "known",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(cells)).cast("int").alias("cell"),
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(frame["n_tokens"].tolist(), capacities)
        frame["bin"], frame["offset"] = bins, offsets
        frame["capacity"] = np.array(final, dtype=np.int64)[bins]
        frame["position"] = frame.groupby("bin").cumcount()
        return frame[["doc_id", "known", "piece", "start", "n_tokens", "cell", "bin", "position", "offset", "capacity"]]

    kind = "doc_id long, known boolean, piece long, start long, n_tokens long, cell int, bin long, position long, offset long, capacity long"
    return restored(celled.groupBy("cell").applyInPandas(one, kind))

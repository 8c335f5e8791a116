"""Stupid-backoff language-model scores of documents from n-gram counts of the whole corpus.

Documents are dealt into blocks; a block explodes its documents into n-grams and counts the distinct ones. The count tables are
partitioned by hash into slices, where the counts of all blocks are summed. Each block's n-grams are joined with these tables in
their slice, so that a block gets the corpus count of each of its n-grams, and sums log scores per document. A frequent
n-gram goes out once per block, so no key is hot. The tables grow with the corpus and are never in one place. From three words on,
a block asks for those n-grams only whose two (n - 1)-grams it has already learnt to be frequent enough, as no other can be. Blocks and slices
have fixed sizes; a block sends a slice one message with all that it has for it, packed, so there are never more messages than
distinct n-grams of blocks, and a plain join of rows would move as many. Keys have 64 bits: among 10 ** 12 distinct n-grams
about 27,000 share a key with another one and are counted together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, inside, n_bytes, restored, text_bytes, window_hashes, with_block, word_codes, word_hashes

_U64 = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Text of a block, of which each distinct n-gram goes out once, and text whose n-grams make up one slice of the count tables.
LM_BLOCK_BYTES, SLICE_BYTES = 10_000_000, 32_000_000


def pack(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, bytes of equal weight side by side, for the compressor."""
    return np.diff(hashes, prepend=_U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() if len(hashes) else b""


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U64).ravel(), dtype=_U64)


def _planes(counts: np.ndarray) -> bytes:
    """Counts with bytes of equal weight side by side. Most are small, so an entropy coder packs them far better than the shuffle's own does."""
    return zlib.compress(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For n from 1 to order, a hash of the n-gram that ends at each word and whether it lies in one document; word counts."""
    out: list[list[np.ndarray]] = [[] for _ in range(order)]
    valid: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    for a, b in chunks(texts):
        words = [t.translate(_LOWER).split() for t in texts[a:b]]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts.append(lengths)
        hashed = word_hashes(*word_codes([w for ws in words for w in ws]))
        for n in range(1, order + 1):
            ending, some = np.zeros(len(hashed), _U64), np.zeros(len(hashed), bool)
            starts = inside(lengths, n)
            ending[starts + n - 1] = window_hashes(hashed, n)[starts]
            some[starts + n - 1] = True
            out[n - 1].append(ending)
            valid[n - 1].append(some)
    laid = lambda parts, kind: [np.concatenate(x) if x else np.zeros(0, kind) for x in parts]
    return laid(out, _U64), laid(valid, bool), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _distinct(ending: np.ndarray, some: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their counts, which one each word has (-1 for none), and where slices begin among them."""
    unique, inverse, count = np.unique(ending[some], return_inverse=True, return_counts=True)
    which = np.full(len(ending), -1)
    which[some] = inverse
    edges = [_U64(-(-(k << 64) // slices)) for k in range(slices)]
    return unique, count, which, np.append(np.searchsorted(unique, np.array(edges, dtype=_U64)), len(unique))


def _known(texts: list[bytes], order: int, slices: int, min_count: int, answers: pd.DataFrame | None) -> tuple[list[np.ndarray], tuple | None, np.ndarray]:
    """Counts of the n-gram that ends at each word (0 where none can be frequent), for n as far as there are answers; what
    `_distinct` says of the next n, if there is one; word counts."""
    endings, valid, lengths = grams(texts, order)
    said = {} if answers is None else {(int(n), int(k)): c for n, k, c in zip(answers["n"], answers["slice"], answers["counts"], strict=True)}
    upto = max((n for n, _ in said), default=0)
    by_n: list[np.ndarray] = []
    for n, (ending, some) in enumerate(zip(endings, valid, strict=True), 1):
        if n > 2:
            frequent = by_n[-1] >= min_count
            some = some & frequent & np.append(False, frequent[:-1])
        distinct = _distinct(ending, some, slices)
        if n > upto:
            return by_n, distinct, lengths
        _, _, which, at = distinct
        found = [_counts(said[n, k]) for k in np.flatnonzero(np.diff(at))]
        by_n.append(np.append(np.concatenate(found) if found else np.zeros(0, np.int64), 0)[which])
    return by_n, None, lengths


def score_documents(docs: DataFrame, order: int = 3, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_words, n_backoffs and log_score of every row.

    Words are lower-cased (A-Z) and parted by blanks. A word's score is count(n-gram) / count(its first n - 1 words) for the longest
    n-gram up to `order` that the corpus holds min_count times or more, times `backoff` for each n-gram passed over, and
    count / number of words for a word alone; log_score sums the natural logarithms. A document without words (null
    or empty text) has log_score 0. Null and repeated ids are rows like any other, and repeated rows count as often as they come. An empty
    table gives an empty result; other columns are ignored. A text is handled whole in one task, with about 100 bytes of memory for each word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(
        F.sum(n_bytes(text)).alias("bytes"), F.sum(F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")).alias("words")
    ).first()
    total, all_words = int(size["bytes"] or 0), max(1, int(size["words"] or 0))
    slices = max(1, -(-total // SLICE_BYTES))
    dealt = with_block(docs, max(1, -(-total // LM_BLOCK_BYTES)))

    def asked(n: int, distinct: tuple, block: int) -> pd.DataFrame:
        unique, counts, _, at = distinct
        rows = [(k, n, block, pack(unique[at[k] : at[k + 1]]), _planes(counts[at[k] : at[k + 1]])) for k in np.flatnonzero(np.diff(at))]
        return pd.DataFrame(rows, columns=["slice", "n", "block", "grams", "counts"])

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        endings, valid, _ = grams([text_bytes(t) for t in frame["text"]], min(2, order))
        parts = zip(endings, valid, strict=True)
        return pd.concat([asked(n, _distinct(*part, slices), int(frame["block"].iloc[0])) for n, part in enumerate(parts, 1)])

    def following(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["slice", "n", "block", "grams", "counts"])
        by_n, distinct, _ = _known([text_bytes(t) for t in frame["text"]], order, slices, min_count, answers)
        return asked(len(by_n) + 1, distinct or (np.zeros(0, _U64), np.zeros(0, np.int64), None, np.zeros(1, np.int64)), int(frame["block"].iloc[0]))

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(g) for g in frame["grams"]]
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        table = np.bincount(inverse, weights=np.concatenate([_counts(c) for c in frame["counts"]])).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        found = [_planes(x) for x in np.split(table[inverse], ends)]
        return pd.DataFrame({"block": frame["block"], "slice": frame["slice"], "n": frame["n"], "counts": found})

    def score(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "known", "n_words", "n_backoffs", "log_score"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        by_n, _, lengths = _known([text_bytes(t) for t in frame["text"]], order, slices, min_count, answers)
        none = np.zeros(int(lengths.sum()), np.int64)
        by_n += [none] * (order - len(by_n))  # no block asked for any n-gram of these lengths
        logs = np.log(np.maximum(by_n[0], 1) / all_words)
        backoffs, done = none.copy(), np.zeros(len(logs), bool)
        position = np.arange(len(logs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for n in range(order, 1, -1):
            possible = position >= n - 1
            before = np.append(0, by_n[n - 2][:-1])
            use = possible & ~done & (by_n[n - 1] >= min_count)
            logs[use] = np.log(by_n[n - 1][use] / before[use])
            done |= use
            backoffs += possible & ~done
        logs += backoffs * np.log(backoff)
        of = np.repeat(np.arange(len(lengths)), lengths)
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "known": frame["known"],
                "n_words": lengths,
                "n_backoffs": np.bincount(of, weights=backoffs, minlength=len(lengths)).astype(np.int64),
                "log_score": np.bincount(of, weights=logs, minlength=len(lengths)).astype(float),
            }
        )

    blocks, message, answer = dealt.groupBy("block"), "slice int, n int, block int, grams binary, counts binary", "block int, slice int, n int, counts binary"
    answers = blocks.applyInPandas(first, message).groupBy("slice", "n").applyInPandas(join, answer)
    for _ in range(3, order + 1):
        more = blocks.cogroup(answers.groupBy("block")).applyInPandas(following, message)
        answers = answers.union(more.groupBy("slice", "n").applyInPandas(join, answer))
    kind = "doc_id long, known boolean, n_words long, n_backoffs long, log_score double"
    return restored(blocks.cogroup(answers.groupBy("block")).applyInPandas(score, kind))

"""Exact token counts at every prefix of a text by dynamic programming over a BPE vocabulary.

In the vocabulary used here no piece holds a space mark after another character, so a text splits before each
run of spaces into chunks whose encodings simply follow one another. Within a chunk the encoding of a prefix is
the encoding of a shorter prefix plus one last piece that is compatible with the piece before it; that gives
the count at every prefix in one pass from left to right, without encoding any prefix.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, evaluated_once

_MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class PrefixCounter:
    """Counts for one sentencepiece BPE model; keeps the table of each distinct chunk, up to a bound."""

    def __init__(self, model_file: str, max_chunks: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in plain}
        if any(_MARK in p.lstrip(_MARK) for p in self.score):
            raise ValueError("a piece of this model reaches over a space, so texts don't split at spaces")
        # A text also splits around each ASCII character that no longer piece holds and, if no piece joins a Latin
        # letter to anything else but the mark in front, where runs of them begin or end.
        joined = {c for p in self.score if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) != " " and chr(i) not in joined)
        letter = re.compile(f"[{_LATIN}]").fullmatch
        mixed = any(bool(letter(x)) != bool(letter(y)) for p in self.score for x, y in zip(p, p[1:]) if x != _MARK)
        inner = f"[^{_MARK}{alone}]+" if mixed else f"(?:[{_LATIN}]+|[^{_MARK}{alone}{_LATIN}]+)"
        self.chunk = re.compile(f"[{alone}]|{_MARK}*{inner}|{_MARK}+")
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                ends.setdefault(p[-3:], set()).add(len(p))
        # Lengths of the pieces that end in some three characters, or else in some two.
        self.lengths = {
            k: sorted(v | ({2} if k[-2:] in ends and len(k) == 3 else set()), reverse=True) for k, v in ends.items()
        }
        self.tables: dict[str, bytes] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_follows = 0
        for p in [p for p in self.score if len(p) > 1 and self._merged(p) != [p]]:
            del self.score[p]  # no sequence of merges makes it
        self.max_chunks = max_chunks

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated best merge; leftmost first among equal scores."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        if self.n_follows > 1_000_000:
            self.follows.clear()
            self.n_follows = 0
        self.n_follows += 1
        known = self.follows.setdefault(left, {})[right] = self._merged(left + right) == [left, right]
        return known

    def _learn(self, chunks: set[str]) -> None:
        """Tables of these chunks. In sorted order each goes on from the prefix it shares with the one before."""
        score, lengths, follows, none = self.score, self.lengths, self.follows, {}
        count, last, previous = [0], [""], ""
        for chunk in sorted(chunks):
            shared, most = 0, min(len(chunk), len(previous))
            while shared < most and chunk[shared] == previous[shared]:
                shared += 1
            previous = chunk
            del count[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(chunk) + 1):
                ends = lengths.get(chunk[end - 3 : end]) if end > 2 else None
                for n in ends or lengths.get(chunk[end - 2 : end] if end > 1 else "", ()):
                    start = end - n
                    if start < 0:
                        continue
                    piece = chunk[start:end]
                    if piece not in score:
                        continue
                    before = last[start]
                    if before:
                        fits = follows.get(before, none).get(piece)
                        if not (self._compatible(before, piece) if fits is None else fits):
                            continue
                    count.append(count[start] + 1)
                    last.append(piece)
                    break
                else:
                    piece = chunk[end - 1]
                    known = piece in score
                    # an unknown character counts its UTF-8 bytes
                    count.append(count[end - 1] + (1 if known else len(piece.encode("utf-8", "surrogatepass"))))
                    last.append(piece if known else "")
            self.tables[chunk] = array("i", count[1:]).tobytes()

    def prefix_counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the numbers of tokens of text[:i], i from 0 to its length."""
        split = [self.chunk.findall(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
        if len(self.tables) > self.max_chunks:
            self.tables.clear()
        new = set().union(*split).difference(self.tables)
        self._learn(new)
        for parts in split:
            if not parts:
                yield np.zeros(1, np.int32)
                continue
            out = np.frombuffer(b"".join(map(self.tables.__getitem__, parts)), np.int32).copy()
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            totals = out[np.cumsum(sizes) - 1]
            out += np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)
            out[0] = 0  # the mark put before a text is no prefix of its own
            yield out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_for(model_file: str) -> PrefixCounter:
    """One counter for each worker process, so that tasks share what it knows of chunks."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def within_budget(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix that takes no more tokens than the budget."""
    return int(np.flatnonzero(counts <= budget)[-1])


def count_tokens(docs: DataFrame, model_file: str, budget: int = 4096, with_table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and budget_chars (code points of the longest prefix within the budget).

    with_table adds prefix_tokens: the count at every prefix. A null text counts as empty: no tokens. Rows are
    kept as they come, repeated or with a null doc_id; an empty table stays empty; other columns are ignored. A very long text is counted
    whole in one task, with 8 bytes of memory for each of its prefixes besides its chunks. The model file must exist on every executor.
    """
    kind = T.StructType().add("n_tokens", "long").add("budget_chars", "long")
    if with_table:
        kind = kind.add("prefix_tokens", T.ArrayType(T.LongType()))

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_for(model_file)
        for texts in batches:
            rows, texts = [], list(texts)
            for a, b in chunks([t.encode("utf-8", "surrogatepass") for t in texts]):
                for counts in counter.prefix_counts(texts[a:b]):
                    rows.append((int(counts[-1]), within_budget(counts, budget), *([counts] if with_table else [])))
            yield pd.DataFrame(rows, columns=kind.names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), evaluated_once(counted, kind, text).alias("c")).select(
        "doc_id", "n_bytes", "c.n_tokens", (F.col("c.n_tokens") > budget).alias("over_limit"), *[f"c.{x}" for x in kind.names[1:]]
    )

"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Line features feed the two states; transitions tie neighbouring lines, whose features a line also
sees. Forward-backward marginals, weighted by line length, add up to the score of a document. The chain is trained
by gradient on a bounded sample of labelled documents, each of whose lines takes the label of the document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import evaluated_once

#: Labelled documents at most that training takes: those whose hashes come first.
TRAINING_DOCS = 6000
#: Bytes of text at most that the driver holds for training.
TRAINING_BYTES = 64_000_000
#: Bytes of one text at most that trains.
LONGEST_BYTES = 4_000_000
#: Characters of a line over which it is cut into stretches of that many, each a step of the chain.
STRETCH = 400
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_N_OWN = 14


def lines_of(text: str | None) -> list[str]:
    """Lines with something in them; a long line counts as several."""
    out = []
    for line in (text or "").split("\n"):
        if line.strip():
            out += [line] if len(line) <= STRETCH else [line[i : i + STRETCH] for i in range(0, len(line), STRETCH)]
    return out


def features(lines: list[str]) -> np.ndarray:
    """A row for each line: its own features, then those of the lines before and after it."""
    own = np.zeros((len(lines), _N_OWN))
    seen: set[str] = set()
    all_words: dict[str, int] = {}
    for i, line in enumerate(lines):
        words = line.split()
        n = max(1, len(words))
        unique = len(set(words))
        letters = sum(map(str.isalpha, line))
        upper = sum(map(str.isupper, line)) if letters else 0
        again = sum(map(all_words.__contains__, words))
        for w in words:
            all_words[w] = 1
        own[i] = (
            1.0,
            min(2.0, 4 * len(_SYMBOLS.findall(line)) / n),
            upper / max(1, letters),
            1.0 - unique / n,
            (1.0 - unique / n) ** 0.5,
            min(2.0, line.count("!!") / n * 2),
            min(2.0, line.count(" | ") / n * 4),
            float(line in seen),
            math.log1p(len(words)) / 5,
            float(len(words) < 4),
            min(3.0, len(line) / n / 8),
            float(line.rstrip()[-1:] in ".!?…\"»"),
            1.0 - letters / max(1, len(line)),
            again / n,
        )
        seen.add(line)
    out = np.zeros((len(lines), 3 * _N_OWN + 2))
    out[:, :_N_OWN] = own
    out[1:, _N_OWN : 2 * _N_OWN] = own[:-1]
    out[:-1, 2 * _N_OWN : 3 * _N_OWN] = own[1:]
    out[:, -2] = min(1.0, len(lines) / 10)
    out[:, -1] = float(len(lines) == 1)
    return out


class Chain:
    """Weights of the states' difference and of the four transitions."""

    def __init__(self, width: int):
        self.weights = np.zeros(width)
        self.moves = np.zeros((2, 2))

    def marginals(self, emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line of documents laid end to end, and expected transition counts.

        Steps run over all documents at once: step t looks at the t-th line of every document that has one.
        """
        n = len(emissions)
        phi = np.zeros((n, 2))
        phi[:, 1] = emissions
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        alpha, beta = phi.copy(), np.zeros((n, 2))
        longest = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # documents of more than t lines
        for t in range(1, longest):
            at = starts[: live[t]] + t
            alpha[at] += _logsum(alpha[at - 1][:, :, None] + self.moves)
        for t in range(longest - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            beta[at] = _logsum((phi[at + 1] + beta[at + 1])[:, :, None] + self.moves.T)
        both = alpha + beta
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        inner = np.ones(n, bool)
        inner[starts] = False
        to = np.flatnonzero(inner)
        pair = alpha[to - 1][:, :, None] + self.moves + (phi[to] + beta[to])[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)) if len(to) else np.zeros((0, 2, 2))
        return good, pair / pair.sum(axis=(1, 2), keepdims=True)

    def fit(self, rows: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray, rounds: int = 250):
        """Gradient ascent (Adam) on the conditional likelihood of the lines' labels, with an L2 penalty.

        rows, labels and weight are by line; weight balances long and short documents.
        """
        to = np.setdiff1d(np.arange(len(rows)), starts)
        seen = np.zeros((len(to), 2, 2))
        seen[np.arange(len(to)), labels[to - 1], labels[to]] = 1
        first, second = np.zeros(len(self.weights) + 4), np.zeros(len(self.weights) + 4)
        scale = weight.sum()
        for step in range(1, rounds + 1):
            good, pair = self.marginals(rows @ self.weights, starts, lengths)
            grad = np.concatenate(
                [
                    (weight * (labels - good)) @ rows / scale - 1e-5 * self.weights,
                    ((weight[to][:, None, None] * (seen - pair)).sum(axis=0) / scale - 1e-3 * self.moves).ravel(),
                ]
            )
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights += move[:-4]
            self.moves += move[-4:].reshape(2, 2)


def _logsum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=1)
    return most + np.log(np.exp(x - most[:, None]).sum(axis=1))


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines, and the first line and number of lines of each text that has lines, else 0."""
    lines = [lines_of(t) for t in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    rows = np.concatenate([features(x) for x in lines if x] or [np.zeros((0, 3 * _N_OWN + 2))])
    sizes = np.array([len(x) for ls in lines for x in ls], dtype=float)
    return rows, sizes, np.cumsum(counts) - counts, counts


def scores(chain: Chain, texts: list[str | None], empty: float) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; texts without lines get `empty`."""
    rows, sizes, starts, counts = laid_out(texts)
    out = np.full(len(texts), empty)
    some = counts > 0
    if some.any():
        good, _ = chain.marginals(rows @ chain.weights, starts[some], counts[some])
        out[some] = np.add.reduceat(good * sizes, starts[some]) / np.add.reduceat(sizes, starts[some])
    return np.clip(out, 0.0, 1.0)


def train(texts: list[str], quality: np.ndarray) -> tuple[Chain, float]:
    """The chain and the share of good documents."""
    rows, _, starts, counts = laid_out(texts)
    some = counts > 0
    quality, starts, counts = quality[some], starts[some], counts[some]
    chain = Chain(3 * _N_OWN + 2)
    if len(quality):
        weight = np.repeat(1.0 / counts, counts)
        chain.fit(rows, np.repeat(quality, counts), starts, counts, weight)
    return chain, float(quality.mean()) if len(quality) else 0.5


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = TRAINING_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from a chain trained on labelled rows that aren't held out.

    A text without lines (null, empty or blank) scores the share of good documents among the training rows. A null doc_id is
    held out. Without any labels all texts score by an untrained chain, 0.5. Rows whose label is null don't train, rows that repeat a
    doc_id with another label or text train on each once. Repeated rows score alike, an empty table gives an empty result, and
    other columns are ignored. Texts over LONGEST_BYTES, and those that would take the training beyond TRAINING_BYTES, don't train, which
    leaves all others in; every text is scored whole, in one task.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    known = known.filter(~held_out() & F.col("quality").isin(0, 1))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").dropna()
    rows = rows.withColumns({"size": F.octet_length("text").cast("long"), "digest": F.xxhash64("text")})
    # Keys and sizes first, and the texts of those chosen after that, so that no task and no sum holds more than the bound.
    sizes = rows.filter(F.col("size") <= LONGEST_BYTES).select("doc_id", "quality", "digest", "size").distinct()
    sizes = sizes.orderBy(F.xxhash64("doc_id"), "digest", "quality").limit(2 * sample)  # repeated ids may give more rows than labels
    chosen, held = [], 0
    for r in sizes.collect():
        if held + r["size"] <= TRAINING_BYTES:
            chosen.append(r)
            held += r["size"]
    picked = docs.sparkSession.createDataFrame(chosen, sizes.schema).drop("size")
    rows = rows.join(F.broadcast(picked), ["doc_id", "quality", "digest"]).dropDuplicates(["doc_id", "quality", "digest"]).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    chain, share = train([r["text"] for r in rows], np.array([r["quality"] for r in rows], dtype=np.int64))
    return docs.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(True)).alias("held_out"),
        evaluated_once(_scorer(chain, share), "double", F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scorer(chain: Chain, empty: float) -> Callable:
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            parts = [scores(chain, texts[i : i + 200], empty) for i in range(0, len(texts), 200)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score

"""Quality rules as weak supervision: rules vote or abstain, and a latent quality explains their votes.

Each rule votes good or bad on a document or abstains. Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes which way on good and on bad documents, and how many documents
are good; a document is judged by its posterior, so one objection of a rule that is often wrong doesn't reject it. There
are at most 3 ** rules patterns, so the estimate needs one aggregation of the corpus and a loop over a small table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, evaluated_once, inside, text_bytes, unused, window_hashes, word_codes, word_hashes

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"
_CONTINUED = bytes(range(0x80, 0xC0))
_BEYOND_ASCII = bytes(range(0x80, 0x100))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDLESS = re.compile(rb"(?<![^ \t-\r])[^A-Za-z\x80-\xff \t-\r]+(?![^ \t-\r])")
#: Function words of the languages that the rule on them knows; texts in others show few of them.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this are from or an not have",
    "de": "der die das und in den von zu mit sich des auf f\u00fcr ist im dem nicht ein eine als auch es an",
    "es": "de la que el en y los del se las por un para con no una su al lo es m\u00e1s",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur plus pas ne ce",
}
_COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_letters long, n_bangs long, n_other long, n_wordless long, n_function long"
)
_NAMES = [x.split()[0] for x in _COUNTS.split(", ")]
REPEAT_WORDS = 5


def _deleted(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[list[bytes]], width: int = REPEAT_WORDS) -> np.ndarray:
    """Per document, the words that lie in a run of `width` words found twice or more in it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = inside(lengths, width)
    if not len(starts):
        return np.zeros(len(words), np.int64)
    of = np.repeat(np.arange(len(words)), lengths)
    hashed = window_hashes(word_hashes(*word_codes([w for ws in words for w in ws])), width)[starts]
    hashed = hashed ^ (of[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, inverse, count = np.unique(hashed, return_inverse=True, return_counts=True)
    twice = starts[count[inverse] > 1]
    edge = np.zeros(len(of) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.bincount(of, weights=np.cumsum(edge[:-1]) > 0, minlength=len(words)).astype(np.int64)


def text_counts(texts: list[bytes]) -> pd.DataFrame:
    words = [t.split() for t in texts]
    known = frozenset(w.encode() for ws in FUNCTION_WORDS.values() for w in ws.split())
    rows = []
    for text, ws in zip(texts, words, strict=True):
        lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
        points = len(text) - _deleted(text, _CONTINUED)
        rows.append(
            (
                len(ws),
                points - _deleted(text, _BLANKS),
                _deleted(text, _SYMBOLS),
                len(lines) - len(set(lines)),
                0,
                len(lines),
                _deleted(text, _UPPER),
                _deleted(text, _LETTERS),
                text.count(b"!!"),
                _deleted(text, _BEYOND_ASCII) - _deleted(text, _CONTINUED),
                len(_WORDLESS.findall(text)),
                sum(map(known.__contains__, text.translate(_LOWER).split())),
            )
        )
    out = pd.DataFrame(rows, columns=_NAMES)
    out["n_repeat_words"] = repeated_words(words)
    return out


def _counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text_bytes(t) for t in batch]
        parts = [text_counts(texts[a:b]) for a, b in chunks(texts)]
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=_NAMES, dtype="int64")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit("0")).when(good, F.lit("1")).otherwise(F.lit("-"))


def rules(counts: Column) -> dict[str, tuple[Column, Column]]:
    """name -> (votes good, votes bad) from a struct of counts; a rule where neither holds abstains. The thresholds are the parameters.

    Several rules look at one fault from different sides (marks, letters, function words), since accuracies can only be
    estimated from how rules agree.
    """
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    words, lines, chars = counts["n_words"], counts["n_lines"], counts["word_chars"]
    symbols, dup = share(counts["n_symbols"], words), share(counts["n_dup_lines"], lines)
    letters, wordless = share(counts["n_letters"] + counts["n_other"], chars), share(counts["n_wordless"], words)
    function, repeat, length = share(counts["n_function"], words), share(counts["n_repeat_words"], words), share(chars, words)
    upper, bangs = share(counts["n_upper"], counts["n_letters"]), share(counts["n_bangs"], words)
    return {
        "few_symbols": (symbols < 0.05, symbols > 0.3),
        "mostly_letters": (letters > 0.9, letters < 0.7),
        "words_have_letters": (wordless < 0.05, wordless > 0.2),
        "function_words": (function > 0.1, (words >= 20) & (function < 0.02)),
        "new_lines": ((lines >= 3) & (dup < 0.1), (lines >= 3) & (dup > 0.4)),
        "new_phrases": ((words >= 30) & (repeat < 0.02), (words >= 10) & (repeat > 0.15)),
        "word_length": ((length >= 3) & (length <= 7), (length < 2.5) | (length > 10)),
        "mostly_lower_case": (upper < 0.2, (words >= 10) & (upper > 0.7)),
        "few_bangs": (bangs < 0.02, bangs > 0.2),
        "enough_words": (words >= 50, words < 15),
    }


#: Pseudo-counts (objections, approvals) of a rule on bad and on good documents: a good document draws few objections.
PRIOR = ((1.0, 1.0), (0.1, 1.0))


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern; P(a rule that votes objects | bad, good), (2, rules); share of good documents.

    EM for votes that are independent given the quality; whether a rule votes at all is taken to tell nothing of the quality.
    Rates and share are free, but for the pseudo-counts of PRIOR. It starts from "no rule objects", which fixes which of the
    two classes is the good one.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros((2, 0)), 0.5
    objects, approves = (np.array([[x == v for x in p] for p in patterns], dtype=float) for v in "01")
    good = np.where(objects.any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        share = float((counts @ good + 1) / (counts.sum() + 2))
        rate = np.empty((2, objects.shape[1]))
        for y, weight in ((1, counts * good), (0, counts * (1 - good))):
            against, for_ = weight @ objects + PRIOR[y][0], weight @ approves + PRIOR[y][1]
            rate[y] = against / (against + for_)
        odds = np.log(share / (1 - share)) + objects @ np.log(rate[1] / rate[0]) + approves @ np.log((1 - rate[1]) / (1 - rate[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good, rate, share


def _base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 10) | (counts["n_repeat_words"] * 100 > counts["n_words"] * 20)


def _votes(counts: Column) -> Column:
    return F.concat(*[_vote(good, bad) for good, bad in rules(counts).values()])


def _counted(text: Column) -> Column:
    return evaluated_once(_counts, _COUNTS, text.cast("string"))


def posteriors(counted: DataFrame, counts: str, votes: str, posterior: str) -> DataFrame:
    """A small table (votes, posterior) from the column of counts of all rows that pass the base rules: at most 3 ** rules rows."""
    of = F.col(counts)
    patterns = counted.filter(~_base_failed(of)).groupBy(_votes(of).alias(votes)).agg(F.count("*").alias("n")).orderBy(votes).collect()
    good, _, _ = estimate([r[votes] for r in patterns], np.array([r["n"] for r in patterns], float))
    rows = [(r[votes], float(p)) for r, p in zip(patterns, good, strict=True)]
    return counted.sparkSession.createDataFrame(rows, f"`{votes}` string, `{posterior}` double")


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, votes and posterior of every row.

    A null or empty text has no words and so fails the base rule of at least 10 words; rows that fail it have a null posterior
    and take no part in the estimate. Every row is judged by its own text, so repeated rows and ties get equal verdicts; null
    and repeated doc_ids are rows like any other, other columns are ignored, and an empty table stays empty. A text is counted
    whole in one piece, in memory of a few times its size.
    """
    counted = checkpoint(docs.select("doc_id", _counted(F.col("text")).alias("counts")))
    known = posteriors(counted, "counts", "votes", "posterior")
    return (
        counted.withColumn("votes", _votes(F.col("counts")))
        .withColumn("base_failed", _base_failed(F.col("counts")))
        .join(F.broadcast(known), "votes", "left")
        .select(
            "doc_id",
            *[F.col(f"counts.{x}") for x in _NAMES[:5]],
            "base_failed",
            (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"),
            "votes",
            F.when(~F.col("base_failed"), F.col("posterior")).alias("posterior"),
        )
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names; see quality_verdicts for odd input.

    Texts are counted twice, for the estimate and for the verdicts, so that no copy of them is written between.
    """
    counts, votes, posterior = (unused(x, docs.columns) for x in ("counts", "votes", "posterior"))
    known = posteriors(docs.select(_counted(F.col("text")).alias(counts)), counts, votes, posterior)
    passed = docs.withColumn(counts, _counted(F.col("text"))).filter(~_base_failed(F.col(counts)))
    judged = passed.withColumn(votes, _votes(F.col(counts))).join(F.broadcast(known), votes)
    return judged.filter(F.col(posterior) >= threshold).select(*docs.columns)

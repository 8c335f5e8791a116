"""A corpus from raw documents to packed sequences; each stage calls one operator on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitpanel.llm import decontaminate, near_dedup, packing, substring_dedup, weak_rules
from pitpanel.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the posterior of the weak rules keep.

    A null, empty or short text goes, a null or repeated doc_id doesn't matter, an empty table stays empty.
    """
    return weak_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: five words, similarity of 0.8 or more.

    Texts without words and rows with a null doc_id stay; of rows that repeat doc_id and text one stays.
    """
    return near_dedup.one_of_each(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that a document with a smaller doc_id holds.

    All rows stay, in the end with an empty text; null texts and rows with a null doc_id stay as they are, and repeated rows of a
    doc_id take nothing from each other.
    """
    return substring_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate; texts without words, null texts and rows with a null doc_id among them.

    Repeated rows are judged alike, an empty table stays empty, and an empty benchmark lets all stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence of permitted length.

    A text without words is one piece of length 0; null and repeated doc_ids and repeated rows are rows like any other, and an empty
    table stays empty.
    """
    import public_tokenizers  # the other stages and queries do without it

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: The quality rules' estimate and best-fit packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's table is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
            scratch.drop(before)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)

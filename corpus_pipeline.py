"""A training corpus from raw documents: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and
returns a frame; ``run`` writes each stage's result under the shared folder and gives what it
reads back to the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import importable, stored, table
from colloquy.llm.packing import pack, pieces_of, tokenizer_path
from colloquy.llm.quality import THRESHOLD, fit, learnable, score_documents
from colloquy.llm.simhash import without_copies
from colloquy.llm.suffixes import remove_repeats

REPEAT_WORDS = 51
REPEAT_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score under the threshold; the model learns as in the query."""
    importable(spark)
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score_documents(docs, model).where(F.col("score") >= THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least id, of each group of near copies."""
    importable(spark)
    return without_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that occur elsewhere; every document stays.

    Repeats are found as runs of ``REPEAT_BYTES`` equal bytes and judged by their whole words.  So
    a passage of 51 words is seen unless its words have under three letters each on average.  A
    null text comes out empty; ``n_chars`` is counted anew.
    """
    importable(spark)
    cut = remove_repeats(docs, window=REPEAT_BYTES, gram=REPEAT_BYTES // 2, keep="text", words=REPEAT_WORDS)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096."""
    importable(spark)
    return pack(pieces_of(docs, tokenizer_path(), with_ids=False))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packing),
]

# training, searching and sorting cannot be said in SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

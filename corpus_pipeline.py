"""The corpus pipeline: language, repeated lines, near copies, repeated passages, packed sequences.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last give the columns of ``documents``, with ``n_chars`` for the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import cut, table
from cellwright.llm.jaccard import keep_first
from cellwright.llm.langid import drop_rejected, fit
from cellwright.llm.line_dedup import remove_repeats
from cellwright.llm.packing import pack_documents
from cellwright.llm.substring_dedup import remove_passages


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` being the length of the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart with enough certainty; others go, texts without a letter among them."""
    return drop_rejected(docs, fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand in an earlier place."""
    return _recounted(remove_repeats(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier place."""
    return _recounted(remove_passages(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, one after the other, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained models and minimum hashes have no SQL form.
ORACLE_SQL = None

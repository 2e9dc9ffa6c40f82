"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, in the columns of documents for all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import load, mark, settle
from tidewell.llm.near_dup import drop_near_duplicates
from tidewell.llm.packing import pack_documents, piece_digests
from tidewell.llm.quality_classifier import keep_good
from tidewell.llm.quality_rules import keep_clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, then documents that lost too much or fail the base rules.
    Null and empty texts go; null keys, repeated rows and other columns pass."""
    return keep_clean(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the discriminant scores below 0.3; with no labels of a class, none.
    Null texts are scored as empty; null keys and repeated rows are scored like any other."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (similarity 0.85, five words).
    Repeated rows become one; rows with a null doc_id and texts without words stay."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, one row a piece; a null or
    empty text is its end id alone."""
    return piece_digests(pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: The discriminant's training and the tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet to the shared folder and read again.
    What a stage wrote on its way, and its input, go once its output is written. An empty table gives
    no rows; null keys pass every stage, null texts end at the first, repeated rows become one at the
    third, ties of copies keep the smallest doc_id. Columns beyond those of documents pass, too."""
    docs, since = load(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)

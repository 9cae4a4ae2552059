"""Documents to tokens: quality rules, exact and near duplicates, a weighted mix, encoding."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentrylane.llm.common import stored, table
from sentrylane.llm.exact_dedup import drop_exact
from sentrylane.llm.minhash_trees import drop_near
from sentrylane.llm.mixing import mixed_rows
from sentrylane.llm.pieces import tokens
from sentrylane.llm.quality import cleaned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules do not reject, without the common lines of their host."""
    return cleaned(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, one row each, repeats included."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every piece, and whether they decode to its text."""
    return tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: No SQL: near duplicates are a search, the mix is drawn, and pieces are found by Viterbi.
#: tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents:
rows pass or go, and the mix repeats a row as often as it takes it.  An empty table gives an
empty one.  Null texts count as empty ones, and null ids and sources as values of their own;
further columns are carried along.  What is said of ties below holds for repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routelake.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from routelake.llm.common import documents, table
from routelake.session import staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score is at or over the threshold; empty texts score as no match, and equal texts alike."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the smallest id, of rows that repeat it the one whose columns hash lowest."""
    return exact_dedup.surviving(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the Jaccard join, the smallest id; rows that repeat it, and texts without words, all stay."""
    return jaccard_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the sources' target weights, some of them twice; of rows with one id, source and size the one whose columns hash lowest goes first."""
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' words into bins; every row is packed, repeated ones each on their own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The learned toxicity score has no SQL form; ``tests/llm/test_brute_force.py`` compares the first four stages with plain Python, and the last one's bins with its rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

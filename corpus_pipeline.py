"""From raw documents to shards: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a data frame that is written
as Parquet and read again as the next stage's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendtrace.llm.classifier import accepted
from spendtrace.llm.common import table
from spendtrace.llm.decontaminate import without_contaminated
from spendtrace.llm.jaccard import one_of_each
from spendtrace.llm.mixture import mixed_documents
from spendtrace.llm.shard import place_rows
from spendtrace.session import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of the benchmark's windows."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix of the sources takes."""
    return mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return place_rows(docs)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", different),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# The quality classifier is fitted by an iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

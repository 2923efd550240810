"""The corpus pipeline: each stage calls one operator and takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidmill.llm.common import quoted, table
from braidmill.llm.decontaminate import remove_contaminated
from braidmill.llm.jaccard import keep_one_per_component
from braidmill.llm.mixing import mix_sources
from braidmill.llm.quality import keep_quality
from braidmill.llm.sharding import shard_documents
from braidmill.session import bookmark, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or dropped) so that sources reach their target weights."""
    return mix_sources(docs).select(*map(quoted, docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot; all columns go along."""
    return shard_documents(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier's scores cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read back.

    The result has the columns of ``shard_documents`` and all others of the
    table.  Null and empty texts are scored like texts without words, have no
    near duplicates and hold no benchmark; repeated rows are near duplicates of
    each other; a null doc_id or source is a value like any other.  Columns
    called like those of the stages stay as they are, but for the last stage,
    which puts underscores behind the table's.  An empty table gives an empty
    result.  Tables that a stage left behind are removed when the next has been
    written.
    """
    docs, since = table(spark, sf_dir, "documents"), bookmark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, since)
    return docs

"""A training corpus from raw documents: five stages, each one DataFrame job.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftframe.llm import decontaminate, hilbert, langid, mixing, simhash
from driftframe.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the rejected ones go."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents come up to twice, the last one of a source cut to its target."""
    return mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and place in it."""
    return hilbert.digest(docs, carry=True)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", source_mixing), ("sharding", sharding)]

#: Several stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the scratch folder and read back as the next one's input."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs

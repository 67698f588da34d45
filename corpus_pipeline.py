"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of ``documents``; each is written as Parquet and read again as the next
one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import mixing, ngram_join, packing, quality_rules, secrets
from emberlog.llm.common import ready, table
from emberlog.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules reject go."""
    return quality_rules.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.without_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced by the name of their kind."""
    return secrets.without_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: where each document stands in which training sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the divergence rules nor the links' components on whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(ready(spark), f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}

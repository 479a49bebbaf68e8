"""Cleans the documents table in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cellgraph.llm import stages
from cellgraph.session import ensure_checkpoint_dir

#: (name, function of spark, docs, sf_dir)
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_copies", stages.near_copies),
    ("private_data", stages.private_data),
    ("mixing", stages.mixing),
    ("best_fit_packing", stages.best_fit_packing),
]
#: SQL cannot express the personal-data stage; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    home = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

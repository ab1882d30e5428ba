"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import decontamination, jaccard, mixing, quality, sharding, storage

STAGES = [
    ("quality classifier", quality.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing sources", mixing.stage),
    ("sharding", sharding.stage),
]
#: The stages hash, train and iterate, which SQL can't express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs, path = storage.cut(stage(spark, docs, sf_dir), "stage")
        if before:
            storage.drop(spark, before)
        before = path
    return docs

"""The corpus pipeline: stages over `documents`, each reading what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docframe.llm import decontaminate, jaccard, mixing, quality, sharding
from docframe.llm.common import remove, shared_dir, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def slot_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs, map_path=sharding.start_map(spark, sharding.new_map_path(spark)))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", slot_sharding),
]

#: Rounding depends on hashes that SQL lacks; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written as Parquet to the shared folder and read again.

    A stage's input is deleted once its result is committed, so that the folder holds two copies of the corpus at most.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/docframe/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        with small_batches(spark):
            done.write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            remove(spark, f"{at}/{i - 1}")
    return docs

"""Corpus pipeline: each stage reads what the stage before it kept.

All stages but the last return the columns of ``documents``. ``ORACLE_SQL`` is None: the fitted classifier and the
sampled segmentation cannot be written in SQL, so ``tests/llm/test_pipeline.py`` holds the result against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelcohort.llm import stages
from voxelcohort.session import scratch_path

STAGES = [
    ("quality classifier", stages.keep_good),
    ("n-gram Jaccard join", stages.keep_one_of_each),
    ("benchmark decontamination", stages.drop_leaks),
    ("PII", stages.replace_personal_data),
    ("SentencePiece encoding and decoding", stages.encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = scratch_path(spark, "pipeline-result")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)

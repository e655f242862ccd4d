"""Corpus pipeline: quality filter, near-duplicates, repeated passages, mixing, encoding."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isomere.llm import stages
from isomere.runtime import durable

STAGES = [
    ("quality", stages.quality),
    ("simhash", stages.simhash),
    ("repeats", stages.repeats),
    ("mix", stages.mix),
    ("bpe", stages.bpe),
]

#: SQL cannot train the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

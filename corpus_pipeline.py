"""Corpus pipeline: documents in, token files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written as Parquet and read as the next one's docs."""
    return pipeline.run(spark, sf_dir, STAGES)

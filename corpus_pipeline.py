"""A corpus pipeline of five stages: toxicity, line dedup, SimHash near-dedup, mixing to target weights, segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import stages
from quantloom.llm.common import scratch

#: No SQL form: learned scores, fingerprints, draws and sampled segmentations cannot be said in SQL. Tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_repeated_lines(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.segmented(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("segmentation", segmentation)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            df.write.parquet(path)
            df = spark.read.parquet(path)
    return df

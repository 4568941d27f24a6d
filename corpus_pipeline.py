"""The corpus, stage by stage: each takes all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeglass.llm import common, jaccard, packing, quality, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon finds toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go."""
    return quality.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts that are left, packed into bins: see packing.packed for the columns."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("quality", good_quality), ("near_duplicates", near_duplicates), ("packing", bins)]

#: SQL can't express the random walk, the connected groups and the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

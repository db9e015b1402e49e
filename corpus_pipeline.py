"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. SQL cannot express the estimates, signatures and tokenizer of the stages, so ORACLE_SQL is None and the stages
are tested against brute force. How a stage treats nulls, ties and repeated rows stands with its operator's function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm import decontaminate, mixing, near_dup, quality, token_binary
from colonnade.llm.common import materialize

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the estimates of their group reject go; null and short texts are among them."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, that of the least doc_id."""
    return near_dup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which eight consecutive words of any benchmark item (or a whole shorter one) occur go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in blocks that hold all sources in these weights."""
    return mixing.mix_sources(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in the order of the mixture's table, so that its blocks reach the output; a table that is in no file has no order and goes by doc_id."""
    return token_binary.digest(docs, table_order=bool(docs.inputFiles()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

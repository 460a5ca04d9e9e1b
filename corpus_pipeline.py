"""Corpus pipeline: language, near copies, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but
for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import decontaminate, langid, mixing, ngram_join, sharding
from lithoframe.llm.storage import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; those rejected go."""
    return langid.identify(docs).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of linked ones."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture: read in file order, every source keeps its share, and the shards take over that order."""
    return mixing.in_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their positions in the mixture and their shards; each shard lies in one part, in the order of the mixture.

    The positions are those in the files that the mixture was written to.
    """
    return sharding.shards(mixing.positions(docs)).repartition("shard").sortWithinPartitions("shard", "position")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("shards", shards)]

#: SimHash lookups and trigram models are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

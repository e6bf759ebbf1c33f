"""A corpus in five stages: toxicity, near-duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared folder and read again as the next one's docs. All but the last return the columns
of documents. Nulls, repeated rows and empty tables: see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluviogrid.llm import decontamination, minhash_dedup, mixing, sharding, toxicity
from pluviogrid.llm.common import drop_folder, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more of five-word shingles, the document with the smallest id stays."""
    return minhash_dedup.deduplicate(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified passage of the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (or left out) by Poisson counts, so that sources get the root of their bytes as weight."""
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, shard and slot, in shards of near equal bytes."""
    return sharding.shard_documents(docs)


STAGES = [("toxicity", reject_toxic), ("minhash_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: No SQL expresses the trained, hashed and verified stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one. A stage's folder goes once the next one is written, the last one's with the session."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

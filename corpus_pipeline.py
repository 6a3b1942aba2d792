"""The corpus pipeline: toxicity, MinHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage is (name, f(spark, docs, sf_dir)); run() writes every stage's rows as Parquet to the
shared folder and reads them again for the next. Null or empty texts pass the three filters
unless a model says otherwise, an empty table stays empty, repeated rows count as one near
duplicate, and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, decontam, minhash, mixing, sharding, toxicity

SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, shard and slot of every row of the mix."""
    return sharding.shard(docs, n_shards=SHARDS).drop("_row")


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]
#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.llm import alignment, audit, common, decontam, hyperplanes, minhash, mixing, packing, pages, quality, secrets, sharding, tokens, toxicity
from cairn.llm.sql import OP1, OP2, OP6, OP7, OP11

SHARDS, TOKEN_LIMIT, SEQUENCE = 16, 512, 2048


def op1_mixing(spark, sf_dir):
    out = mixing.plan_mix(common.table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents")).drop("_key")


def op3_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def op4_sharding(spark, sf_dir):
    out = sharding.shard(common.table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark, sf_dir):
    return decontam.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark, sf_dir):
    return hyperplanes.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op7_quality(spark, sf_dir):
    return quality.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_token_counts(spark, sf_dir, path: str | None = None, limit: int = TOKEN_LIMIT):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    out = tokens.count_tokens(common.table(spark, sf_dir, "documents"), path)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_html_extraction(spark, sf_dir):
    return pages.extract_pages(common.table(spark, sf_dir, "pages"))


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(common.table(spark, sf_dir, "documents")))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark, sf_dir, path: str | None = None, most: int = SEQUENCE):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(common.table(spark, sf_dir, "documents"), path, most).drop("ids")


def op13_tokenizer_alignment(spark, sf_dir, a_path: str | None = None, b_path: str | None = None):
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(common.table(spark, sf_dir, "documents"), a_path, b_path).drop("groups")


_ALL = (op1_mixing, op2_minhash, op3_toxicity, op4_sharding, op5_decontamination, op6_embedding_dedup, op7_quality, op8_token_counts, op9_html_extraction, op10_secret_scan, op11_filter_audit, op12_best_fit_packing, op13_tokenizer_alignment)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_mixing": OP1, "op2_minhash": OP2, "op6_embedding_dedup": OP6, "op7_quality": OP7, "op11_filter_audit": OP11}

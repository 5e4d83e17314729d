"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, exact_dedup, langid, line_dedup, mixing, packing, sharding, simhash, toxicity
from ._common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "lines", "deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.copies(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("passages").alias("passages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(read(spark, sf_dir, "conversations"))
    return found.withColumnRenamed("conv", "conv_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(read(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), law, "shard", "slot", grown)


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_simhash, op3_line_dedup, op4_packing, op5_exact_dedup, op6_embedding_near_dedup, op7_language_id, op8_toxicity, op9_chat_formatting, op10_sharding)
}

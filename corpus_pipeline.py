"""The corpus pipeline: toxic documents, exact and near copies go, sources are mixed, documents are packed.

Every stage takes any documents: null and empty texts are texts without words, which equal each other in the copy
stages, stay once in the mix and pack as their end token; rows are decided by id and text, so rows that share an id or
have none go only for their own text; columns of other names pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm import exact_dedup, mixing, near_sets, packing, toxicity
from symlake.llm._common import Scratch, read
from symlake.llm.queries import tokenizer_path

Stage = tuple[SparkSession, DataFrame, str]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learns from the labels of the documents at hand."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id: SimHash links, verified, and what they cannot reach of Jaccard 0.8."""
    return near_sets.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, whose token counts are powers of two, with their tokens."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "bucket", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_documents),
]

#: Learned scores, XXH64 and token ids cannot be had from SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs

"""Structured Streaming over folders of tables with root, rel_path and text (an extension: the batch tables do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract
from ..sources.tree import crawl

SCHEMA = "root string, rel_path string, text string, seen timestamp"


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def analyse_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses of the files that arrive; stateless, exactly once with any exactly-once sink."""
    files = crawl(read_stream(spark, folder))
    return extract(files.withColumns({"path": F.col("rel_path"), "file_id": F.md5(F.concat_ws("\u0000", "root", "rel_path"))}))


def count_stream(spark: SparkSession, folder: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files by window and type; a window's state goes when the watermark has passed it."""
    files = crawl(read_stream(spark, folder)).withWatermark("seen", late)
    return files.groupBy(F.window("seen", window), "file_type").agg(F.count(F.lit(1)).alias("files"))

"""Tables in the shared folder, size-checked broadcasts and global row numbers."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where intermediate tables go if a session of one process names no spark.checkpoint.dir.
LOCAL_SHARED = "/tmp/checkpoints"
#: Rows, and bytes of their strings, that a table may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: Bytes of a batch of rows that a task sends to Python.
BATCH_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word contracts: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def _small_batches(spark: SparkSession):
    """While a table is written, batches of rows for Python have BATCH_BYTES at most, however long the texts are."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


class Scratch:
    """Tables written to the shared folder that the session names in spark.checkpoint.dir.

    A written table cuts the lineage and outlives any executor. Tables are deleted by
    drop() when no later step reads them, and all that remain when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = LOCAL_SHARED
        self.root = f"{root.rstrip('/')}/symlake-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(where):
            for status in files.listStatus(where):
                if status.getPath().getName() not in names:
                    files.delete(status.getPath(), True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM is gone, and with a test session so is the need
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, since workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows and BROADCAST_BYTES of strings, else left to shuffled joins."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(long, F.lit(0)).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= rows and found["bytes"] <= BROADCAST_BYTES else df


def one_of_each(df: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """Of rows with one key (nulls being equal) that `keys` has more than once, the earliest."""
    repeated = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*[F.col(c).alias(f"__of_{c}") for c in key])
    same = [df[c].eqNullSafe(F.col(f"__of_{c}")) for c in key]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    first = placed.join(repeated, [placed[c].eqNullSafe(F.col(f"__of_{c}")) for c in key], "left_semi")
    first = first.groupBy(*key).agg(F.min_by(row, "__place").alias("__row"))
    return df.join(repeated, same, "left_anti").unionByName(first.select("__row.*"))


def split_join(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """The rows with the columns of a table that has each key once and in n how many rows have it.

    Keys with a fourth of a task's share of the rows or more are few (four times the tasks at most); they are
    broadcast, so that their rows stay where they are. All others are joined by a shuffle.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > max(1, total // (4 * partitions(rows.sparkSession)))
    hot = table.where(often)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.where(~often), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def lowered(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(scratch: Scratch, df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """Adds gapless numbers from 0 in the given order, without one task that sorts all rows.

    Rows are dealt by range; each range is numbered by itself and moved by the size of the
    ranges before it. That table of ranges has one row per partition.
    """
    dealt = scratch.table(
        df.repartitionByRange(partitions(df.sparkSession), *[F.col(c).asc_nulls_last() for c in order]).withColumn("__block", F.spark_partition_id()),
        name,
    )
    sizes = dealt.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return dealt.withColumn("__in", within).join(F.broadcast(before), "__block").withColumn(out, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__block", "__in", "__before")

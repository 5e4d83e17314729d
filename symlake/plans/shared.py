"""Tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shared:
    """Tables written below spark.checkpoint.dir, or below a folder of this machine if the session runs in one process.

    A written table is made once for all its uses and outlives lost executors. drop() deletes all of them; so does the
    end of the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "/tmp/checkpoints"
        self.spark, self.root = spark, f"{root.rstrip('/')}/symlake-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM is gone, and the session's folder with it
            pass

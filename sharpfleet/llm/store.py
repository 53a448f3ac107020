"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-store-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """Named Parquet tables in one fresh shared folder; a table is written once and read by later jobs.

    Shuffle files of a table's job go when it is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def put(self, df: DataFrame, name: str, *partition: str, codec: str = "zstd") -> DataFrame:
        writer, conf = df.write.option("compression", codec).mode("errorifexists"), self.spark.conf
        before = conf.get(FREED)
        conf.set(FREED, "true")
        try:
            (writer.partitionBy(*partition) if partition else writer).parquet(self.path(name))
        finally:
            conf.set(FREED, before)
        return self.get(name, df)

    def get(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read.schema(like.schema) if like is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later job reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

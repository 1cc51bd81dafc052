"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.store import work_folder


class Scratch:
    """Tables written as Parquet, so that what follows doesn't depend on the executors that made them.

    drop() deletes a table as soon as a later one has replaced it; the rest go at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            return

    def keep(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        table.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

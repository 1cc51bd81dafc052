"""Committed snapshots: state by step, cached tables by fingerprint. Readers see whole commits only."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fingerprint(parameters: dict) -> str:
    """Eight hexadecimal digits over every parameter."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:8]


class Snapshots:
    """Tables root/<key>=<n>, each written once and valid once its commit marker is there."""

    def __init__(self, spark: SparkSession, root: str, key: str = "t"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of whole snapshots, ascending."""
        at, files = self._path(self.root)
        if not files.exists(at):
            return []
        found = []
        for entry in files.listStatus(at):
            name = entry.getPath().getName()
            mark, _ = self._path(f"{self.root}/{name}/_SUCCESS")
            if name.startswith(f"{self.key}=") and files.exists(mark):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def write(self, table: DataFrame, number: int) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.root}/{self.key}={number}")
        return self.read(number, table)

    def read(self, number: int, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(f"{self.root}/{self.key}={number}")

    def drop(self, number: int) -> None:
        at, files = self._path(f"{self.root}/{self.key}={number}")
        files.delete(at, True)

    def describe(self, parameters: dict) -> None:
        """Notes the parameters, or fails if the folder was begun with others."""
        at, files = self._path(f"{self.root}/about-{fingerprint(parameters)}")
        parent, _ = self._path(self.root)
        others = [e.getPath().getName() for e in files.listStatus(parent) if e.getPath().getName().startswith("about-")] if files.exists(parent) else []
        if others and f"about-{fingerprint(parameters)}" not in others:
            raise ValueError("this folder holds the state of a run with other parameters")
        files.mkdirs(at)


def cached(spark: SparkSession, root: str, parameters: dict, make) -> DataFrame:
    """The table of these parameters below root; made and written if it isn't there whole."""
    store = Snapshots(spark, f"{root}/{fingerprint(parameters)}", "v")
    return store.read(0) if 0 in store.committed() else store.write(make(), 0)

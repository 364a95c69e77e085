"""Named tables below one folder, so that what an engine loaded and fitted outlives its session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Parquet folders ``<path>/<name>/<version>``; the youngest complete version counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        path, fs = self._folder(name)
        if not fs.exists(path):
            return []
        done = [s for s in fs.listStatus(path) if s.isDirectory() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return [s.getPath().toString() for s in sorted(done, key=lambda s: (s.getModificationTime(), s.getPath().toString()))]

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written as a new version and read back; older versions go, once the new one is complete."""
        old = self._versions(name)
        target = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(target)
        for path in old:
            self._delete(path)
        return self.spark.read.schema(df.schema).parquet(target)

    def get(self, name: str) -> DataFrame | None:
        found = self._versions(name)
        return self.spark.read.parquet(found[-1]) if found else None

    def drop(self, name: str) -> None:
        path, fs = self._folder(name)
        if fs.exists(path):
            fs.delete(path, True)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

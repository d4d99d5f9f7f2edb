"""Small tables that a stream keeps between micro-batches.

A batch reads version ``n`` and writes version ``n + 1`` whole; a batch that is
run again after a failure reads and writes the same versions, so every job on
top is idempotent in its batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class VersionedTable:
    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:09d}"

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """Version 0 is empty; a version is complete once its success mark exists."""
        if version == 0:
            return spark.createDataFrame([], self.schema)
        if not _exists(spark, self._path(version) + "/_SUCCESS"):
            raise RuntimeError(f"{self.folder} has no version {version}")
        return spark.read.schema(self.schema).parquet(self._path(version))

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._path(version))


class BatchLog:
    """An append-only table with one folder per batch; a repeated batch replaces its own rows."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def read_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if not _exists(spark, self.folder):
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(f"{self.schema}, batch_id bigint").parquet(self.folder)
        return rows.filter(rows.batch_id < batch_id).drop("batch_id")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")

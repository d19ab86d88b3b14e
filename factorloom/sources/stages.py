"""Tables between the steps of a long computation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, as in tests, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="factorloom-"))
        top = _own[0]
    return top.rstrip("/")


class Stages:
    """Parquet tables of one computation, each written once and read by what follows; they outlive the loss of executors and cut the plan."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.held = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []
        self.count = 0

    def store(self, df: DataFrame) -> DataFrame:
        path, self.count = f"{self.folder}/{self.count:04d}", self.count + 1
        df.write.option("compression", "zstd").parquet(path)
        self.held.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def next(self, df: DataFrame) -> DataFrame:
        """store(), after which the tables before are deleted."""
        old = list(self.held)
        out = self.store(df)
        for path in old:
            self.drop(path)
        return out

    def drop(self, path: str) -> None:
        self.held.remove(path) if path in self.held else None
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, and the characters between two words once A-Z are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A side with more rows or bytes than this is never broadcast; a shuffled join takes its place.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16_000_000
#: The same for lists of 64-bit ids.
IDS = 400_000

#: Stands for a null doc_id inside an operator.
NO_ID = -(1 << 63)

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with NO_ID for a null doc_id, so that joins by doc_id find it."""
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def named() -> Column:
    """doc_id as it was before keyed()."""
    return F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id")


def by_text(docs: DataFrame) -> DataFrame:
    """docs with a struct of doc_id (NO_ID for null) and a hash of the text in place of doc_id.

    Rows that share a doc_id, or lack one, but differ in text are kept apart; rows
    alike in both get the same result anyway. Unlike a row number it is the same in
    every scan, so nothing need be stored. Texts of one id whose 64-bit hashes
    collide count as one.
    """
    return docs.withColumn("doc_id", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")))


def named_by_text() -> Column:
    """doc_id as it was before by_text()."""
    return F.nullif(F.col("doc_id.id"), F.lit(NO_ID)).alias("doc_id")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order, as an array; none for an empty text."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a temporary one only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="factorloom-"))
        top = _own_dir[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: later steps read it again instead of computing it again, also after the loss of executors.

    Spark deletes shuffle files once the driver has collected what refers to
    them; `release` collects at once, for steps that shuffle much.
    """
    return _written(df, shared_dir(df.sparkSession, name), release)


def _written(df: DataFrame, path: str, release: bool = False) -> DataFrame:
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    for _ in range(3 * release):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Owns the tables of one computation: they lie in one shared folder, which is deleted when the block ends.

    What is returned from the block must be stored() elsewhere before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_dir(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if it has at most `limit` rows of `max_bytes` together; otherwise df as it is, for a shuffled join."""
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= max_bytes else df


def small_ids(df: DataFrame) -> DataFrame:
    """small() for a list of ids, of which more rows fit."""
    return small(df, IDS)


def parts_for(docs: DataFrame, column: str = "text", part_bytes: int = 256_000_000) -> int:
    """How many parts hold `part_bytes` of the column each, but at least as many as shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes), 1)


def once(docs: DataFrame) -> DataFrame:
    """docs with rows repeated in doc_id and text once; of rows that differ in other columns the one that is first as JSON stays.

    Only the ids are counted over all rows, and only rows of repeated ids are moved.
    """
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        return docs
    again = small_ids(again)
    same = F.col("doc_id").eqNullSafe(again["again"])
    whole, key = F.struct(*docs.columns), ("doc_id", F.coalesce("text", F.lit("")))
    first = docs.join(again, same, "left_semi").groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return docs.join(again, same, "left_anti").select(docs.columns).union(first.select(docs.columns))

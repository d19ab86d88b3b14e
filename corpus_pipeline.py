"""The corpus pipeline: quality, exact and near duplicates, contamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import decontamination, exact_dedup, minhash, packing, quality
from factorloom.llm.common import delete, shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(docs)


#: Each stage gets (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("decontamination", clean), ("packing", packed)]

#: The trained classifier and the tokenizer can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over all rows of the last one, which is written as Parquet and read again; a stage's table is deleted once the next one's is written."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        last, folder = folder, shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            delete(spark, last)
    return docs

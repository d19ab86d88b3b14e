"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import once, small_ids, stored, texts


def _hashed(docs: DataFrame, prefix_chars: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"), F.sha2(text, 256).alias("text_sha256"), F.struct(*docs.columns).alias("doc"))


def _groups(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """text_sha256, keep (largest doc_id) and n for every text that may stand twice: those that share length and prefix with another.

    Counts are combined before each shuffle, stored, and brought back by joins,
    whose hot keys Spark can split; text itself is never shuffled.
    """
    base = texts(docs).withColumn("n_bytes", F.octet_length("text"))
    sizes = stored(base.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes"), "sizes")
    by_prefix = base.select("n_bytes", F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"))
    prefixes = stored(by_prefix.join(sizes, "n_bytes", "left_semi").groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "prefixes")
    met = _hashed(texts(docs), prefix_chars).join(prefixes, ["n_bytes", "prefix"], "left_semi")
    return stored(met.groupBy("text_sha256").agg(F.max("doc.doc_id").alias("keep"), F.count("*").alias("n")), "groups")


def exact_duplicates(docs: DataFrame, prefix_chars: int = 128) -> DataFrame:
    """One row per document with the group of identical texts that it is in.

    Documents are grouped by byte length, those that share a length by the hash
    of a prefix, and those that share both by the SHA-256 of the whole text.

    Returns doc_id, keep_id (largest doc_id of the group), group_size, kept,
    text_sha256. A null text counts as an empty one, and empty texts are equal
    to each other. A null doc_id counts as smaller than all others. A row
    repeated with its doc_id counts in group_size each time, and all its repeats
    carry the same flag. An empty table gives no rows; columns beyond doc_id and
    text are not read.
    """
    groups = _groups(docs, prefix_chars)
    rows = _hashed(texts(docs), prefix_chars).select("doc.doc_id", "text_sha256")
    keep_id = F.coalesce("keep", "doc_id")
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, prefix_chars: int = 128) -> DataFrame:
    """The documents without exact copies (of equal texts the largest doc_id stays), all their columns kept.

    Each row is judged by its own text, and only the groups of two and more are
    brought to the texts. Nulls count as in exact_duplicates(); rows repeated
    with doc_id and text stay once, whatever else they hold; an empty table stays
    empty.
    """
    groups = small_ids(_groups(docs, prefix_chars).filter("n > 1").select("text_sha256", "keep", F.lit(True).alias("copied")))
    marked = _hashed(docs, prefix_chars).select("doc", "text_sha256").join(groups, "text_sha256", "left")
    return once(marked.filter(F.col("copied").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("keep"))).select("doc.*"))

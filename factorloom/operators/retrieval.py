"""Retrieval of stored vectors by their similarity."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries that are compared with all stored rows at once.
BLOCK = 500


def in_blocks(queries: DataFrame, key: str, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `compare` gives for a stated set of queries, which it gets in broadcast blocks of about BLOCK rows, dealt by a hash of their key."""
    n = max(1, math.ceil(queries.count() / BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, (compare(F.broadcast(queries.filter(block == b))) for b in range(n)))


def nearest(memory: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, place: the k stored vectors most like each of a stated set of queries (ties by vec_id); neighbours() takes every row as one."""
    compare = lambda some: memory.join(some).filter("vec_id != query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("similarity"))
    scored = in_blocks(queries, "query_id", compare)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).filter(F.col("place") <= k)


def neighbours(memory: DataFrame, k: int, block_rows: int = 2048) -> DataFrame:
    """query_id, vec_id, similarity, place: the k stored vectors most like each stored vector, as nearest() has them with every row as a query.

    Rows are dealt into blocks of about `block_rows`; every pair of blocks is
    compared in a task of its own, and of its best k a query only the best k stay.
    Vectors without a similarity (null, zero, of another length) come last. Rows
    without vec_id are left out.
    """
    held = memory.filter("vec_id IS NOT NULL")
    n = max(1, math.ceil(held.count() / block_rows))
    dealt = held.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = dealt.withColumn("other", others)
    held_by = dealt.select(F.col("vec_id").alias("m_id"), F.col("embedding").alias("m_vector"), F.col("block").alias("m_block"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("for_block"))

    def units(vectors: pd.Series, size: int) -> np.ndarray:
        out = np.full((len(vectors), size), np.nan)
        for i, v in enumerate(vectors):
            if v is not None and len(v) == size and size:
                x = np.asarray(v, dtype=float)
                norm = math.sqrt(x @ x)
                out[i] = x / norm if norm else np.nan
        return out

    def best(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        q, m = q.reset_index(drop=True), m.sort_values("m_id", kind="stable")
        ids, found = m["m_id"].to_numpy(), []
        lengths = q["embedding"].map(lambda v: -1 if v is None else len(v))
        for size, part in q.groupby(lengths):
            score = np.full((len(part), len(m)), np.nan) if size < 1 else np.round(units(part["embedding"], size) @ units(m["m_vector"], size).T, 6)
            for query, row in zip(part["vec_id"].to_numpy(), score, strict=True):
                other = np.flatnonzero(ids != query)
                first = other[np.argsort(-row[other], kind="stable")[:k]]  # NaN last, ties by vec_id
                found.append(pd.DataFrame({"query_id": query, "vec_id": ids[first], "similarity": row[first]}))
        return pd.concat(found)

    each = asked.groupBy("block", "other").cogroup(held_by.groupBy("for_block", "m_block")).applyInPandas(best, "query_id long, vec_id long, similarity double")
    scored = each.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).filter(F.col("place") <= k)

"""The state of a market, and a memory of factors that is searched by likeness, state and quality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.vector_index import BLOCK, GROUP, GROUPS, _by_length

#: Limits between the labels of each regime.
VOLATILITY, INDEX, RATE, MATCHING, TREND = (0.15, 0.25), (15.0, 25.0), (2.0, 3.5), (0.3, 0.6), (0.98, 1.02)
#: Queries that meet a group of stored factors in one task, and those that are compared with it at once.
QUERIES, TILE = 4096, 64
STATE = ("volatility", "liquidity", "trend", "correlation")
#: Weight of what is new when a stored factor's figures are updated.
NEW = 0.3


def _label(x: Column, limits: tuple[float, float], names: tuple[str, str, str], otherwise: str) -> Column:
    return F.when(x.isNull(), otherwise).when(x < limits[0], names[0]).when(x < limits[1], names[1]).otherwise(names[2])


def market_proxy(panel: DataFrame) -> DataFrame:
    """date, close: the mean close of all instruments."""
    return panel.groupBy("date").agg(F.avg("close").alias("close"))


def market_state(market: DataFrame, short: int = 20, long: int = 60, periods: int = 252) -> DataFrame:
    """date and the labels volatility, liquidity, trend, correlation of a market (date, close, and index, rate, matching where it has them), with what is known up to each date.

    Volatility is that of an index where there is one, else the yearly deviation
    of the last 20 returns (medium before there are 20). Liquidity follows an
    interest rate. Trend compares the means of the last 20 and 60 closes; with
    fewer closes than 60 the last one with the one four before, and sideways under
    five. Correlation follows the mean correlation of returns. What is unknown
    gives medium or normal. Dates without a close are left out. One row per date.
    """
    known = market.filter("close is not null")
    every = Window.orderBy("date")
    row = F.row_number().over(every)
    over = lambda n: every.rowsBetween(1 - n, 0)
    r = known.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(every)) - 1)
    dev = F.when(row > 20, F.stddev_samp("_r").over(over(20)) * periods**0.5)
    optional = lambda c: F.col(c) if c in market.columns else F.lit(None).cast("double")
    volatility = F.when(optional("index").isNotNull(), _label(optional("index"), INDEX, ("low", "medium", "high"), "medium")).otherwise(_label(dev, VOLATILITY, ("low", "medium", "high"), "medium"))
    ratio = F.coalesce(F.try_divide(F.avg("close").over(over(short)), F.avg("close").over(over(long))), F.lit(1.0))
    early = F.when(row >= 5, F.when(F.col("close") > F.lag("close", 4).over(every), "bull").otherwise("bear")).otherwise("sideways")
    trend = F.when(row < long, early).when(ratio > TREND[1], "bull").when(ratio < TREND[0], "bear").otherwise("sideways")
    return r.select("date", volatility.alias("volatility"), _label(optional("rate"), RATE, ("abundant", "normal", "tight"), "normal").alias("liquidity"), trend.alias("trend"), _label(optional("matching"), MATCHING, ("low", "medium", "high"), "medium").alias("correlation"))


def factor_id(expression: str | Column) -> Column:
    return F.substring(F.sha2(F.col(expression) if isinstance(expression, str) else expression, 256), 1, 16)


def quality() -> Column:
    """From ic, sharpe, win_rate and retrieval_count; at most 1."""
    base = 0.5 * F.abs("ic") + 0.3 * F.greatest(F.col("sharpe"), F.lit(0.0)) / 3 + 0.2 * F.col("win_rate")
    return F.least(base + 0.05 * F.log1p("retrieval_count"), F.lit(1.0))


def state_match(a: str, b: str) -> Column:
    """Share of the four labels in which two structs agree."""
    return sum(F.when(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), 1.0).otherwise(0.0) for c in STATE) / len(STATE)


def _whole(x: str) -> Column:
    """A vector as doubles; null where an entry is null."""
    return F.when(~F.exists(x, lambda v: v.isNull()), F.col(x).cast("array<double>")).alias(x)


def _states(held: pa.ChunkedArray, names: dict[tuple[str, str], int]) -> np.ndarray:
    """The labels of states as numbers, one row each; an unknown label is -1."""
    known = [r or {} for r in held.to_pylist()]
    return np.array([[-1 if r.get(c) is None else names.setdefault((c, r[c]), len(names)) for c in STATE] for r in known])


def _best_scores(q: pa.Table, m: pa.Table, k: int, state_weight: float) -> Iterator[pa.Table]:
    """query_id, factor_id, score: the k best factors of m, which lies by factor_id, for each query of q. Unknown scores come last."""
    vectors = {size: (rows, x) for size, rows, x in _by_length(m["embedding"].combine_chunks())}
    names: dict[tuple[str, str], int] = {}
    state, now = _states(m["market_state"], names), _states(q["now"], names)
    good = m["quality"].combine_chunks()
    unknown, weight = good.is_null().to_numpy(zero_copy_only=False), good.fill_null(0.0).to_numpy(zero_copy_only=False)
    for size, rows, u in _by_length(q["query"].combine_chunks()):
        for a in range(0, len(rows), TILE):
            some, part = rows[a : a + TILE], u[a : a + TILE]
            like = np.zeros((len(some), len(m)))
            if size > 0 and size in vectors:
                of, x = vectors[size]
                norms = np.sqrt((part * part).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
                like[:, of] = np.divide(part @ x.T, norms, out=np.zeros_like(norms), where=norms != 0)
            match = sum((now[some, c][:, None] == state[:, c]) & (now[some, c] >= 0)[:, None] for c in range(len(STATE))) / len(STATE)
            score = np.round(((1 - state_weight) * like + state_weight * match) * weight, 9)
            rank = np.where(unknown, -math.inf, np.where(np.isnan(score), math.inf, score))
            edge = np.partition(rank, -k, axis=1)[:, -k] if len(m) > k else np.full(len(some), -math.inf)
            i, j = np.nonzero(rank >= edge[:, None])
            order = np.lexsort((j, -rank[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[first], j[first]
            yield pa.table({"query_id": q["query_id"].take(pa.array(some[i])), "factor_id": m["factor_id"].take(pa.array(j)), "score": pa.array(score[i, j], mask=unknown[j])})


def retrieve(memory: DataFrame, queries: DataFrame, k: int = 5, state_weight: float = 0.3, least_ic: float = 0.02) -> DataFrame:
    """query_id, factor_id, score, place: for each query (query_id, query, now) the k stored factors of the largest score, ties by factor_id.

    The score is the likeness of embeddings and of market states, mixed, times the
    quality. Only factors whose IC (that of validation where there is one) is at
    least `least_ic` count; all do where none is. Factors are dealt into groups; every
    task compares some queries with one group, and of its best k only the best k stay.
    """
    effective = F.when(F.col("has_val") & F.col("val_ic").isNotNull() & ~F.isnan("val_ic"), F.col("val_ic")).otherwise(F.col("ic"))
    good = memory.filter(effective >= least_ic)
    pool = (memory if good.isEmpty() else good).select("factor_id", _whole("embedding"), "market_state", quality().alias("quality"))
    asked = queries.select("query_id", _whole("query"), "now")
    n, parts = pool.count(), max(1, math.ceil(queries.count() / QUERIES))
    groups = max(1, math.ceil(n / GROUP), min(GROUPS, math.ceil(n / BLOCK)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("part", dealt("query_id", parts)).withColumn("group", every(groups)).groupBy("part", "group")
    right = pool.withColumn("group", dealt("factor_id", groups)).withColumn("part", every(parts)).groupBy("part", "group")

    def best(q: pa.Table, m: pa.Table) -> pa.Table:
        some = [*_best_scores(q, m.sort_by("factor_id"), k, state_weight)] if len(q) and len(m) else []
        return pa.concat_tables([none(q, m), *some])

    def none(q: pa.Table, m: pa.Table) -> pa.Table:
        return pa.table({"query_id": q["query_id"].slice(0, 0), "factor_id": m["factor_id"].slice(0, 0), "score": pa.array([], pa.float64())})

    kinds = {c: t.schema[c].dataType for t, c in ((queries, "query_id"), (memory, "factor_id"))}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double"
    scored = left.cogroup(right).applyInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "factor_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def noted(memory: DataFrame, found: DataFrame, when: Column) -> DataFrame:
    """The memory with retrieval_count and last_retrieved of the factors that retrieve() gave."""
    times = found.groupBy("factor_id").agg(F.count("*").alias("_n"))
    both = memory.join(times, "factor_id", "left")
    return both.withColumn("retrieval_count", F.col("retrieval_count") + F.coalesce("_n", F.lit(0))).withColumn("last_retrieved", F.when(F.col("_n").isNotNull(), when).otherwise(F.col("last_retrieved"))).drop("_n")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The memory after new results, one row per factor_id and with the memory's columns: known factors' figures move by NEW towards the new ones, others are added.

    The validation IC moves only where the new result has one.
    """
    figures = ("ic", "icir", "sharpe", "win_rate", "max_drawdown")
    old, fresh = memory.alias("o"), new.alias("n")
    both = old.join(fresh, F.col("o.factor_id") == F.col("n.factor_id"), "full")
    known, update = F.col("o.factor_id").isNotNull(), F.col("n.factor_id").isNotNull()
    mixed = lambda c: (1 - NEW) * F.col(f"o.{c}") + NEW * F.col(f"n.{c}")
    moved = lambda c, when: F.when(known & when, mixed(c)).when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    def column(c: str) -> Column:
        if c in figures:
            return moved(c, update)
        if c == "val_ic":
            return moved(c, F.coalesce(F.col("n.has_val"), F.lit(False)))
        if c == "has_val":
            return (F.coalesce("o.has_val", F.lit(False)) | F.coalesce("n.has_val", F.lit(False))).alias(c)
        return (F.coalesce(f"o.{c}", f"n.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c)

    return both.select([column(c) for c in memory.columns])


def text_vectors(texts: DataFrame, text: str = "description", size: int = 384) -> DataFrame:
    """The rows with `embedding`: hashed word counts weighted by rarity, where no vectors of a language model are at hand."""
    words = texts.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\\W+"), lambda w: w != ""))
    counts = HashingTF(numFeatures=size, inputCol="_w", outputCol="_c").transform(words)
    weighed = IDF(inputCol="_c", outputCol="_v").fit(counts).transform(counts)
    return weighed.withColumn("embedding", vector_to_array("_v")).drop("_w", "_c", "_v")

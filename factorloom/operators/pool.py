"""Admission of factors to a pool, and weights over the factors that are chosen for each date."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.stages import Stages


def admitted(singles: DataFrame, pairs: DataFrame, threshold: float, capacity: int) -> DataFrame:
    """factor, ic, place: the factors that a pool takes, the largest |ic| (null as 0; ties by name) first, none of them correlated beyond `threshold` in size with one taken before, until `capacity` are in.

    singles has factor and ic, pairs a, b and rho, in either order; pairs that lack,
    or have null, count as independent. Factors are decided in rounds: one whose
    earlier neighbours are all refused is taken, one with a neighbour that is taken
    is refused, so a round decides all that no undecided neighbour precedes. Each
    round is a join over the correlated pairs; no figure comes to the driver but the
    number of those left.
    """
    stages = Stages(singles.sparkSession, "pool")
    order = F.struct((-F.abs("ic")).alias("size"), "factor")
    known = stages.store(singles.groupBy("factor").agg(F.coalesce(F.first("ic", ignorenulls=True), F.lit(0.0)).alias("ic")).filter("factor is not null"))
    close = pairs.filter(F.abs("rho") > threshold).select("a", "b")
    key = known.select(F.col("factor").alias("name"), order.alias("key"))
    both = close.union(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    later = both.join(key.toDF("a", "key_a"), "a").join(key.toDF("b", "key_b"), "b").filter("key_b < key_a")
    later = stages.store(later.select("a", "b"))
    state = stages.store(known.select("factor", "ic", F.lit(None).cast("boolean").alias("taken")))
    while not state.filter("taken is null").isEmpty():
        told = later.join(state.select(F.col("factor").alias("b"), F.col("taken").alias("b_taken")), "b")
        seen = told.groupBy("a").agg(F.max(F.coalesce("b_taken", F.lit(False))).alias("met"), F.max(F.col("b_taken").isNull()).alias("open"))
        judged = F.when(F.col("taken").isNotNull(), F.col("taken")).when(F.col("met"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = stages.store(state.join(seen, F.col("factor") == F.col("a"), "left").select("factor", "ic", judged.alias("taken")))
    best = state.filter("taken").orderBy(F.desc(F.abs("ic")), "factor").limit(capacity)
    return best.select("factor", "ic", F.row_number().over(Window.orderBy(F.desc(F.abs("ic")), "factor")).alias("place"))


# --- walk-forward weights over each date's own factors -----------------------


def _mask(present: list[Column]) -> Column:
    return sum((F.when(c, 1 << i).otherwise(0).cast("long") for i, c in enumerate(present)), F.lit(0).cast("long"))


def pattern_moments(wide: DataFrame, factors: list[str], target: str = "target") -> DataFrame:
    """date, pattern, moments: the sums that least squares need, for each date and pattern of known factors (bit i for the i-th) over cells with a target.

    moments is the upper triangle, row by row, of the sums of products of the
    factors, 1 and the target; an unknown factor counts as 0. A choice of factors is
    fitted on the cells that lack none of them: on all patterns that hold its bits.
    """
    if len(factors) > 62:
        raise ValueError("a pattern holds up to 62 factors")
    cells = wide.filter(F.col(target).isNotNull())
    terms = [*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in factors), F.lit(1.0), F.col(target).cast("double")]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    return cells.groupBy("date", _mask([F.col(f).isNotNull() for f in factors]).alias("pattern")).agg(F.array(*sums).alias("moments"))


def chosen_weights(wide: DataFrame, factors: list[str], chosen: DataFrame, embargo: int, window: int | None = None, least_rows: int = 10, target: str = "target") -> DataFrame:
    """date, n, names, weights, intercept: for each date of `chosen` (date, factor) least squares of the target on that date's factors.

    The fit is over the cells of the `window` dates before (all, where None), but
    for the last `embargo`, that lack none of the chosen factors. n counts them;
    with fewer than `least_rows` weights are null. Factors that `factors` doesn't list
    are left out of a choice; a date without any has none.
    """
    size = len(factors) + 2
    index = {f: i for i, f in enumerate(factors)}
    stages = Stages(wide.sparkSession, "moments")
    moments = stages.store(pattern_moments(wide, factors, target))
    names = F.array_sort(F.collect_set("factor"))
    choice = chosen.filter(F.col("factor").isin(*factors)).groupBy("date").agg(names.alias("names"), F.bit_or(F.element_at(F.create_map(*[F.lit(x) for f, i in index.items() for x in (f, 1 << i)]), F.col("factor")).cast("long")).alias("bits"))
    dates = wide.select("date").union(chosen.select("date")).filter("date is not null").distinct()
    grid = dates.join(moments.select("pattern").distinct())  # the calendar for each pattern: as many rows as a table of both
    over = Window.partitionBy("pattern").orderBy("date").rowsBetween(Window.unboundedPreceding if window is None else -window, -embargo - 1)
    n = size * (size + 1) // 2
    dense = grid.join(moments, ["date", "pattern"], "left").select("date", "pattern", *[F.coalesce(F.sum(F.get("moments", F.lit(k))).over(over), F.lit(0.0)).alias(f"m{k}") for k in range(n)])
    held = dense.select("date", "pattern", F.array(*[f"m{k}" for k in range(n)]).alias("m"))
    fitting = choice.join(held, "date", "left").filter((F.col("pattern").bitwiseAND(F.col("bits")) == F.col("bits")) | F.col("pattern").isNull())
    summed = choice.select("date", "names").join(fitting.groupBy("date").agg(*[F.sum(F.get("m", F.lit(k))).alias(f"m{k}") for k in range(n)]), "date", "left").select("date", "names", F.array(*[F.coalesce(f"m{k}", F.lit(0.0)) for k in range(n)]).alias("m"))
    upper = np.triu_indices(size)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for date, names, m in zip(b["date"], b["names"], b["m"], strict=True):
                whole = np.zeros((size, size))
                whole[upper] = m
                whole = whole + np.triu(whole, 1).T
                at = [*(index[x] for x in names), size - 2]
                a, y, count = whole[np.ix_(at, at)], whole[at, size - 1], int(round(whole[size - 2, size - 2]))
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                w = np.linalg.lstsq(a / scale / scale[:, None], y / scale, rcond=1e-13)[0] / scale if count >= least_rows else None
                rows.append((date, count, list(names), None if w is None else w[:-1].tolist(), None if w is None else float(w[-1])))
            yield pd.DataFrame(rows, columns=["date", "n", "names", "weights", "intercept"])

    return summed.mapInPandas(solve, "date date, n long, names array<string>, weights array<double>, intercept double")


def chosen_scores(wide: DataFrame, weights: DataFrame, factors: list[str]) -> DataFrame:
    """date, instrument, score: each cell's chosen factors (unknown ones as 0) by the weights of its date, and the intercept; 0 where the date has no weights."""
    values = F.create_map(*[x for f in factors for x in (F.lit(f), F.coalesce(F.col(f).cast("double"), F.lit(0.0)))])
    both = wide.join(weights, "date").withColumn("values_", values)
    score = F.aggregate(F.zip_with("names", "weights", lambda f, w: F.element_at("values_", f) * w), F.col("intercept"), lambda s, x: s + x)
    return both.select("date", "instrument", F.coalesce(score, F.lit(0.0)).alias("score"))


def adam_weights(single: dict[str, float], mutual: dict[tuple[str, str], float], l1: float = 5e-3, rate: float = 5e-4, patience: int = 500, most: int = 10_000, start: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of a pool of any sign that make w'Mw - 2w'c + 1 + l1 |w| small, by steps with momentum (Adam: decays 0.9 and 0.999).

    single has the IC of each factor, mutual that of pairs, in either order (0
    where it lacks one). It begins with each factor's IC, or `start`, and ends once the loss
    without the penalty has not fallen by more than 1e-6 for `patience` steps, or
    after `most`; the weights after the step of the least loss are returned. All
    figures have the size of the pool.
    """
    names = sorted(single)
    c = np.array([single[f] for f in names])
    m = np.array([[1.0 if a == b else mutual.get((a, b), mutual.get((b, a), 0.0)) for b in names] for a in names]).reshape(len(names), len(names))
    w = np.array([(start or single)[f] for f in names], float)
    first, second, best, least, still = np.zeros_like(w), np.zeros_like(w), w.copy(), np.inf, 0
    for step in range(1, most + 1):
        loss = w @ m @ w - 2 * w @ c + 1
        slope = 2 * m @ w - 2 * c + l1 * np.sign(w)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        still = 0 if least - loss > 1e-6 else still + 1
        if loss < least:
            best, least = w.copy(), loss
        if still >= patience:
            break
    return dict(zip(names, best.tolist(), strict=True))

"""Weights of factors that are learned: walk-forward regression, pool weights, and portfolios of a fused library.

Data are brought down to sums per date or per pair of factors by Spark; what is
solved then has the size of the pool of factors, not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import fusion, portfolio, reports


def daily_moments(wide: DataFrame, factors: list[str], target: str = "target") -> DataFrame:
    """date and the sums that least squares need: of products of each two of the factors, 1 and the target, over the date's cells that lack none of them."""
    whole = wide.na.drop(subset=[*factors, target])
    terms = [*(F.col(f).cast("double") for f in factors), F.lit(1.0), F.col(target).cast("double")]
    pairs = [F.sum(terms[i] * terms[j]).alias(f"m_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    return whole.groupBy("date").agg(*pairs)


def walk_forward_weights(wide: DataFrame, factors: list[str], embargo: int, window: int | None = None, least_rows: int = 10, target: str = "target") -> DataFrame:
    """date, n and weights (one for each factor, then the intercept): least squares over the dates of the window before, but for the last `embargo`, whose targets are not known yet.

    Sums of each date are added over the window (all dates so far where it is
    None); dates with fewer than `least_rows` cells in it have null weights.
    """
    k = len(factors)
    dates = wide.select("date").distinct()
    daily = dates.join(daily_moments(wide, factors, target), "date", "left")
    names = [c for c in daily.columns if c != "date"]
    over = Window.orderBy("date").rowsBetween(Window.unboundedPreceding if window is None else -window, -embargo - 1)
    summed = daily.select("date", *[F.coalesce(F.sum(c).over(over), F.lit(0.0)).alias(c) for c in names])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                m = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)])
                n, size = int(round(m[k, k])), np.sqrt(np.maximum(np.diag(m)[: k + 1], 1e-300))
                scaled = m[: k + 1, : k + 1] / size / size[:, None]
                rows.append((r["date"], n, (np.linalg.lstsq(scaled, m[: k + 1, k + 1] / size, rcond=1e-13)[0] / size).tolist() if n >= least_rows else None))
            yield pd.DataFrame(rows, columns=["date", "n", "weights"])

    return summed.mapInPandas(solve, "date date, n long, weights array<double>")


def walk_forward_scores(wide: DataFrame, factors: list[str], weights: DataFrame) -> DataFrame:
    """date, instrument, score: each cell's factors (null as 0) by the weights of its date; 0 where a date has none."""
    both = wide.join(weights.select("date", "weights"), "date")
    score = sum((F.coalesce(F.col(f), F.lit(0.0)) * F.get("weights", F.lit(i)) for i, f in enumerate(factors)), F.get("weights", F.lit(len(factors))))
    return both.select("date", "instrument", F.coalesce(score, F.lit(0.0)).alias("score"))


def pool_weights(single: dict[str, float], mutual: dict[tuple[str, str], float], rate: float = 0.01, penalty: float = 0.0, rounds: int = 500) -> dict[str, float]:
    """Weights of a pool, not negative and of sum 1, that make the squared distance between the weighted sum and the target small: projected gradient steps, the best weights seen.

    single has the IC of each factor, mutual that of pairs (either order; 0 where
    it lacks one): figures of the pool, gathered from ic_summary() and factor_pairs().
    """
    names = sorted(single)
    if len(names) < 2:
        return dict.fromkeys(names, 1.0)
    ic = np.array([single[f] for f in names])
    m = np.array([[1.0 if a == b else mutual.get((a, b), mutual.get((b, a), 0.0)) for b in names] for a in names])
    w = np.full(len(names), 1 / len(names))
    best, least = w, np.inf
    for _ in range(rounds):
        loss = w @ m @ w - 2 * w @ ic + 1 + penalty * np.abs(w).sum()
        if loss < least:
            best, least = w, loss
        slope = 2 * m @ w - 2 * ic + penalty * np.sign(w)
        w = np.maximum(w - rate * slope, 0)
        if w.sum() > 1e-8:
            w = w / w.sum()
        if np.linalg.norm(slope) < 1e-6:
            break
    return dict(zip(names, best.tolist(), strict=True))


def pooled(exposures: DataFrame, weights: DataFrame) -> DataFrame:
    """date, instrument, value, target: the sum of weight * value over factors made comparable by day, as one factor named pool."""
    mixed = fusion.by_day(exposures).join(weights.select("factor", "weight"), "factor").groupBy("date", "instrument").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.first("target", ignorenulls=True).alias("target"))
    return mixed.select(F.lit("pool").alias("factor"), "date", "instrument", "value", "target")


def normalised_ic(exposures: DataFrame) -> DataFrame:
    """factor, days, ic, rank_ic, rank_icir: values and targets made standard scores by day (null as 0), then the mean daily correlations of values and of places."""
    scored = fusion.by_day(exposures)
    target = fusion.by_day(scored.select("factor", "date", "instrument", F.col("target").alias("value"), F.col("value").alias("_v"))).select("factor", "date", "instrument", F.col("_v").alias("value"), F.col("value").alias("target"))
    placed = target.select("factor", "date", "instrument", reports.places("value", *reports.DAY).alias("value"), reports.places("target", *reports.DAY).alias("target"))
    daily = reports.masked_ic(target).join(reports.masked_ic(placed).withColumnRenamed("ic", "rank_ic"), ["factor", "date"])
    return daily.groupBy("factor").agg(F.count("*").alias("days"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"))


def ensemble_ic(exposures: DataFrame, weights: DataFrame) -> DataFrame:
    """The pool's row of normalised_ic()."""
    return normalised_ic(pooled(exposures, weights))


def weighted_ic(summary: DataFrame, weights: DataFrame) -> DataFrame:
    """One row, ic: the sum of weight * mean_ic, for pools without a target of their own."""
    return summary.join(weights.select("factor", "weight"), "factor").agg(F.sum(F.col("weight") * F.col("mean_ic")).alias("ic"))


def fused_portfolio(exposures: DataFrame, split: str, n: int, penalty: float = 1.0) -> DataFrame:
    """date, instrument, weight from `split` on: factors weighed by what their IC was before it, less what they share, mixed, and the n best names of each date alike."""
    before, after = exposures.filter(F.col("date") < split), exposures.filter(F.col("date") >= split)
    s = reports.ic_summary(reports.paired_ic(before, 3), least_days=2)
    factors = s.select("factor", F.col("mean_ic").alias("ic"), "icir", F.lit(0.0).alias("val_icir"), F.col("days").alias("n_periods"), F.lit(0.0).alias("debate_score"), F.lit(0.0).alias("tilt"))
    weights = fusion.penalised(fusion.shrunk_weights(factors), reports.pooled_pairs(before), penalty)
    return portfolio.top_n(fusion.composite(fusion.mad_zscore(after), weights), n)


def single_portfolio(exposures: DataFrame, factor: str, split: str, n: int) -> DataFrame:
    """date, instrument, weight from `split` on: the n best names of each date by one factor's values, which were computed on the whole history."""
    scores = exposures.filter((F.col("factor") == factor) & (F.col("date") >= split)).select("date", "instrument", F.col("value").alias("score"))
    return portfolio.top_n(scores, n)

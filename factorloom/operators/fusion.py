"""Normalising exposures by date, weighing factors, and composites of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.reports import DAY


def _day() -> Window:
    return Window.partitionBy(*DAY)


def _clipped(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def mad_zscore(exposures: DataFrame, sample: bool = True) -> DataFrame:
    """Values cut at 3 * 1.4826 median distances from the day's median, then standard scores; 0 where all are alike, unchanged under two known cells."""
    middle = exposures.withColumn("_m", F.percentile("value", F.lit(0.5)).over(_day()))
    away = middle.withColumn("_a", F.percentile(F.abs(F.col("value") - F.col("_m")), F.lit(0.5)).over(_day()))
    width = 3 * 1.4826 * F.col("_a")
    cut = away.withColumn("_c", F.when(F.col("_a") > 0, _clipped(F.col("value"), F.col("_m") - width, F.col("_m") + width)).otherwise(F.col("value")))
    dev = (F.stddev_samp if sample else F.stddev_pop)("_c").over(_day())
    z = F.when(F.col("_c").isNull(), None).when(F.count("_c").over(_day()) < 2, F.col("value")).when(dev > 0, F.try_divide(F.col("_c") - F.avg("_c").over(_day()), dev)).otherwise(0.0)
    return cut.withColumn("value", z).drop("_m", "_a", "_c")


def tail_zscore(exposures: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values cut at the day's linear quantiles, then standard scores with 1e-10 added to the deviation."""
    edges = exposures.withColumn("_e", F.percentile("value", F.array(F.lit(low), F.lit(high))).over(_day()))
    cut = edges.withColumn("_c", _clipped(F.col("value"), F.col("_e")[0], F.col("_e")[1]))
    return cut.withColumn("value", (F.col("_c") - F.avg("_c").over(_day())) / (F.stddev_samp("_c").over(_day()) + 1e-10)).drop("_e", "_c")


def by_day(exposures: DataFrame) -> DataFrame:
    """Population standard scores, null as 0."""
    z = F.try_divide(F.col("value") - F.avg("value").over(_day()), F.stddev_pop("value").over(_day()))
    return exposures.withColumn("value", F.coalesce(z, F.lit(0.0)))


def industry_size_residual(exposures: DataFrame, least: int = 20) -> DataFrame:
    """Residuals on industry dummies and ln(size) with an intercept, on days with at least `least` known cells.

    Both sides less their industry means, then one slope a day. A null industry
    joins the day's first by name, as the dropped dummy does. Size counts only
    where all the day's cells have one. Input has `industry` and `size`.
    """
    known = F.col("value").isNotNull()
    first = F.min(F.when(known, F.col("industry"))).over(_day())
    cells = exposures.withColumn("_g", F.coalesce("industry", first)).withColumn("_s", F.when(known, F.ln(F.greatest(F.col("size"), F.lit(1e-10)))))
    group = Window.partitionBy(*DAY, "_g")
    whole = F.count("_s").over(_day()) == F.count("value").over(_day())
    cells = cells.withColumn("_y", F.col("value") - F.avg("value").over(group)).withColumn("_x", F.when(whole, F.col("_s") - F.avg("_s").over(group)).otherwise(F.when(known, 0.0)))
    slope = F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(_day()), F.sum(F.col("_x") * F.col("_x")).over(_day()))
    left = F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")
    return cells.withColumn("value", F.when(F.count("value").over(_day()) < least, F.col("value")).otherwise(left)).drop("_g", "_s", "_y", "_x")


def signs(ic: Column) -> Column:
    return F.when(F.abs(ic) <= 1e-10, 1.0).otherwise(F.signum(ic))


def factor_weights(factors: DataFrame, how: str = "equal") -> DataFrame:
    """factor, weight, sign of factors (factor, place from 0, ic, icir): equal, by size of IC or of ICIR, or decaying with the place."""
    every = Window.partitionBy(F.lit(0))  # one row per factor
    raw = {"equal": F.lit(1.0), "ic_weighted": F.abs("ic"), "icir_weighted": F.abs("icir"), "decay_weighted": F.exp(-0.3 * F.col("place"))}.get(how, F.lit(1.0))
    r = factors.withColumn("_r", raw)
    total = F.sum("_r").over(every)
    return r.select("factor", F.when(total < 1e-8, 1 / F.count("*").over(every)).otherwise(F.try_divide("_r", total)).alias("weight"), signs(F.col("ic")).alias("sign"))


def shrunk_weights(factors: DataFrame, kappa: float = 0.2) -> DataFrame:
    """factor, weight, sign of factors (factor, ic, icir, val_icir, n_periods, debate_score, tilt): squared ICIR drawn to equal weights, then to a prior, then tilted."""
    every = Window.partitionBy(F.lit(0))  # one row per factor
    f = factors.withColumn("_i", F.abs(F.when((F.abs("val_icir") > 1e-8) & (F.abs("val_icir") < float("inf")), F.col("val_icir")).otherwise(F.col("icir"))))
    equal = 1 / F.count("*").over(every)
    rounds = F.min(F.greatest(F.lit(2), F.col("n_periods"))).over(every)
    noise = 1 / (1 + F.greatest(F.lit(0.0), F.var_pop("_i").over(every) * rounds - 1))
    f = f.withColumn("_d", F.greatest(F.lit(0.05), F.least(F.lit(0.5), noise))).withColumn("_q", F.col("_i") * F.col("_i") / (F.sum(F.col("_i") * F.col("_i")).over(every) + 1e-12))
    f = f.withColumn("_w", (1 - F.col("_d")) * F.col("_q") + F.col("_d") * equal).withColumn("_p", F.greatest(F.lit(0.0), F.least(F.lit(10.0), "debate_score")) / 10)
    prior = F.sum("_p").over(every)
    f = f.withColumn("_w", F.when(prior > 1e-8, kappa * F.try_divide("_p", prior) + (1 - kappa) * F.col("_w")).otherwise(F.col("_w"))).withColumn("_w", F.col("_w") * (1 + F.coalesce("tilt", F.lit(0.0))))
    weight = F.when(F.sum("_i").over(every) < 1e-8, equal).otherwise(F.col("_w") / (F.sum("_w").over(every) + 1e-12))
    return f.select("factor", weight.alias("weight"), signs(F.col("ic")).alias("sign"))


def regime_tilt(family: Column, trend: Column, volatility: Column, strength: float = 0.2) -> Column:
    """What a market's state adds to the weight of a factor's family."""
    add = lambda when, s: F.when(when, s).otherwise(0.0)
    low = family == "low_volatility"
    return add((trend == "bull") & (family == "momentum"), strength) + add((trend == "bear") & low, strength) + add((volatility == "high") & low, 0.75 * strength) + add((trend == "sideways") & (family == "value"), 0.5 * strength)


def penalised(weights: DataFrame, pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Weights divided by 1 + alpha * exposure to the others' weights through correlations (a, b, rho), made to sum to 1."""
    ends = pairs.select(F.col("a").alias("factor"), F.col("b").alias("other"), "rho").unionByName(pairs.select(F.col("b").alias("factor"), F.col("a").alias("other"), "rho"))
    shared = ends.join(weights.select(F.col("factor").alias("other"), F.col("weight").alias("_w")), "other").groupBy("factor").agg(F.sum(F.col("rho") * F.col("_w")).alias("_e"))
    rest = F.when(1 - F.col("weight") < 1e-10, 1.0).otherwise(1 - F.col("weight"))
    cut = weights.join(shared, "factor", "left").withColumn("weight", F.col("weight") / (1 + alpha * F.coalesce(F.col("_e"), F.lit(0.0)) / rest))
    every = Window.partitionBy(F.lit(0))  # one row per factor
    return cut.withColumn("weight", F.col("weight") / F.sum("weight").over(every)).drop("_e")


def composite(exposures: DataFrame, weights: DataFrame, limit: int = 10_000) -> DataFrame:
    """date, instrument, score: the sum of sign * weight * value over factors, a missing value as 0, then standard scores of each date.

    The weights, one row per factor, are broadcast up to `limit` rows; beyond
    that the join is left to the planner.
    """
    small = F.broadcast(weights) if weights.limit(limit + 1).count() <= limit else weights
    mixed = exposures.join(small, "factor").groupBy("date", "instrument").agg(F.sum(F.col("sign") * F.col("weight") * F.col("value")).alias("score"))
    day = Window.partitionBy("date")
    z = (F.col("score") - F.avg("score").over(day)) / (F.stddev_samp("score").over(day) + 1e-8)
    return mixed.withColumn("score", F.when(F.count("score").over(day) < 5, F.col("score")).otherwise(z))

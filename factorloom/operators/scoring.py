"""Predictive power of factors: rank correlation with forward returns, quantile spreads, turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.core import rank


def daily_ic(cells: DataFrame) -> DataFrame:
    """date, ic of cells (date, instrument, factor, target): both ranked over their own known cells and centred; the product over common cells."""
    day = Window.partitionBy("date")
    ranked = cells.select("date", rank("factor").alias("f"), rank("target").alias("t"))
    centred = ranked.select("date", (F.col("f") - F.avg("f").over(day)).alias("f"), (F.col("t") - F.avg("t").over(day)).alias("t"))
    ic = F.try_divide(F.sum(F.col("f") * F.col("t")), F.sqrt(F.sum(F.col("f") * F.col("f"))) * F.sqrt(F.sum(F.col("t") * F.col("t"))))
    return centred.groupBy("date").agg(ic.alias("ic")).filter("ic is not null")


def ic_summary(ic: DataFrame) -> DataFrame:
    """n, mean_ic, icir and the share of positive days."""
    return ic.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def quantile_spread(cells: DataFrame, least: int = 15) -> DataFrame:
    """date, spread: mean target of the top fifth less that of the bottom fifth, edges by linear quantiles, equal edges dropped."""
    known = cells.filter("factor is not null and target is not null")
    levels = F.array(*[F.lit(q) for q in (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)])
    edges = known.groupBy("date").agg(F.count("*").alias("n"), F.array_distinct(F.percentile("factor", levels)).alias("e")).filter((F.col("n") >= least) & (F.size("e") > 2))
    placed = known.join(edges, "date").select("date", "target", (F.col("factor") <= F.col("e")[1]).alias("low"), (F.col("factor") > F.element_at("e", -2)).alias("high"))
    return placed.groupBy("date").agg((F.avg(F.when(F.col("high"), F.col("target"))) - F.avg(F.when(F.col("low"), F.col("target")))).alias("spread"))


def rank_stability(cells: DataFrame, least: int = 3) -> DataFrame:
    """date, stability: 1 less the mean change of percentile ranks since the date before, over common names."""
    dates = cells.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    ranked = cells.withColumn("r", rank("factor")).filter("r is not null").join(F.broadcast(dates), "date").select("instrument", "date", "i", "r")
    before = ranked.select("instrument", (F.col("i") + 1).alias("i"), F.col("r").alias("was"))
    return ranked.join(before, ["instrument", "i"]).groupBy("date").agg(F.count("*").alias("n"), (1 - F.avg(F.abs(F.col("r") - F.col("was")))).alias("stability")).filter(F.col("n") >= least).select("date", "stability")


def zscore(x: str = "factor", least: int = 5) -> Column:
    """Per date, left as it is where fewer than `least` cells are known."""
    day = Window.partitionBy("date")
    return F.when(F.count(x).over(day) < least, F.col(x)).otherwise((F.col(x) - F.avg(x).over(day)) / (F.stddev_samp(x).over(day) + 1e-8))


def minmax(x: str = "factor") -> Column:
    day = Window.partitionBy("date")
    width = F.max(x).over(day) - F.min(x).over(day)
    return F.when(F.col(x).isNull(), None).when(width <= 1e-8, 0.5).otherwise(F.try_divide(F.col(x) - F.min(x).over(day), width))


def industry_residual(x: str = "factor") -> Column:
    """x less its industry's mean on the date; the date's first industry by name stays as it is."""
    known = F.when(F.col(x).isNotNull(), F.col("industry"))
    first = F.min(known).over(Window.partitionBy("date"))
    return F.when(F.col("industry") == first, F.col(x)).otherwise(F.col(x) - F.avg(x).over(Window.partitionBy("date", "industry")))

"""Reports over a finished factor, composite score or portfolio, and families of formulas by their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import portfolio, reports, scoring

#: Words by which a formula's text is put into a family, the first family that has one counts.
FAMILIES = {
    "Liquidity": ("volume", "amt", "turnover", "illiquid"),
    "Volatility": ("ts_std", "ts_max", "ts_min", "ts_skew", "ts_kurt"),
    "Momentum": ("ts_corr", "ts_cov", "ts_pct_change", "ts_delta", "ts_rank", "returns", "momentum"),
    "Mean-reversion": ("ts_zscore", "reversal", "mean_reversion"),
    "Growth": ("growth", "eps"),
    "Value/Quality": ("pe", "pb", "ps", "roe", "roa", "market_cap", "value", "margin", "debt", "quality"),
}


def family(text: Column | str) -> Column:
    """The family of a formula's text, null as empty; Other where it has no word of any."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    held = F.lit("Other")
    for name, words in reversed(FAMILIES.items()):
        held = F.when(text.rlike("|".join(words)), name).otherwise(held)
    return held


def market_return(panel: DataFrame) -> DataFrame:
    """date, market: the mean of the next row's change of close over instruments; dates without one are left out."""
    by = Window.partitionBy("instrument").orderBy("date")
    ahead = F.try_divide(F.lead("close").over(by), F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1
    return panel.select("date", ahead.alias("r")).groupBy("date").agg(F.avg("r").alias("market")).filter("market is not null")


def split_ic(exposures: DataFrame, split: str, least: int = 3) -> DataFrame:
    """part (train, up to and with `split`, or test), factor, days, mean_ic: the mean daily rank IC on both sides of a date, and place, the largest mean first (ties by factor)."""
    daily = reports.paired_ic(exposures, least).filter("spearman is not null")
    part = F.when(F.col("date") <= F.lit(split).cast("date"), "train").otherwise("test")
    means = daily.groupBy(part.alias("part"), "factor").agg(F.count("*").alias("days"), F.avg("spearman").alias("mean_ic"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("mean_ic"), "factor")))


def signed_spread(cells: DataFrame) -> DataFrame:
    """days, ic, spread: the mean of the daily spreads of the top over the bottom fifth, turned by the sign of the mean rank IC (0 without one)."""
    ic = scoring.daily_ic(cells).agg(F.avg("ic").alias("ic"))
    spread = scoring.quantile_spread(cells).filter("spread is not null").agg(F.count("*").alias("days"), F.avg("spread").alias("mean"))
    return spread.join(ic).select("days", "ic", (F.coalesce(F.signum("ic"), F.lit(0.0)) * F.col("mean")).alias("spread"))  # one row each


def composite_test_ic(scores: DataFrame, panel: DataFrame, horizon: int, start: str) -> DataFrame:
    """n, mean_rank_ic, icir of composite scores (date, instrument, score) against the change of close over `horizon` rows, from `start` on."""
    by = Window.partitionBy("instrument").orderBy("date")
    ahead = panel.select("date", "instrument", (F.try_divide(F.lead("close", horizon).over(by), F.col("close")) - 1).alias("target"))
    cells = scores.filter(F.col("date") >= F.lit(start).cast("date")).select("date", "instrument", F.col("score").alias("factor")).join(ahead, ["date", "instrument"])
    return scoring.ic_summary(scoring.daily_ic(cells)).select("n", F.col("mean_ic").alias("mean_rank_ic"), "icir")


def portfolio_report(daily: DataFrame, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """One row from (date, ret, market): annual_return, alpha, and the figures of return_metrics().

    alpha is the annual mean of the return less what beta times the market's explains.
    """
    figures = portfolio.return_metrics(daily, periods, risk_free)
    sums = daily.agg(F.count("*").alias("n"), F.product(1 + F.col("ret")).alias("grown"), F.avg("ret").alias("mean"), F.avg("market").alias("mean_market"))
    both = figures.join(sums)  # one row each
    free = risk_free / periods
    alpha = (F.col("mean") - (F.lit(free) + F.col("beta") * (F.col("mean_market") - free))) * periods
    return both.select((F.pow("grown", F.lit(float(periods)) / F.col("n")) - 1).alias("annual_return"), alpha.alias("alpha"), *figures.columns)


def factor_report(exposures: DataFrame, panel: DataFrame, names: int = 50, periods: int = 252) -> DataFrame:
    """factor, days, ic, icir of each factor, and sharpe, max_drawdown and win_rate of holding its `names` largest cells of a date, equally, until the next."""
    ranked = reports.ic_summary(reports.paired_ic(exposures)).select("factor", "days", F.col("mean_ic").alias("ic"), "icir")
    by = Window.partitionBy("instrument").orderBy("date")
    ahead = panel.select("date", "instrument", (F.try_divide(F.lead("close").over(by), F.col("close")) - 1).alias("ret"))
    place = F.row_number().over(Window.partitionBy("factor", "date").orderBy(F.desc("value"), "instrument"))
    held = exposures.filter("value is not null").withColumn("place", place).filter(F.col("place") <= names).join(ahead, ["date", "instrument"])
    daily = held.groupBy("factor", "date").agg(F.avg("ret").alias("ret")).filter("ret is not null")
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.product(1 + F.col("ret")).over(past))
    down = nav.withColumn("down", F.col("nav") / F.max("nav").over(past) - 1)
    sums = down.groupBy("factor").agg(F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * periods**0.5, F.lit(0.0)).alias("sharpe"), F.min("down").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    return ranked.join(sums, "factor", "left")

"""Top-n portfolios and a backtest whose drift between rebalances is a product over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(scores: DataFrame, n: int, proportional: bool = False) -> DataFrame:
    """date, instrument, weight: the n best scores of each date (ties by instrument), equal or in proportion to the score above the least."""
    best = scores.filter("score is not null").withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "instrument"))).filter(F.col("place") <= n)
    day = Window.partitionBy("date")
    raw = F.col("score") - F.min("score").over(day) + 1e-6 if proportional else F.lit(1.0)
    return best.withColumn("raw", raw).select("date", "instrument", (F.col("raw") / F.sum("raw").over(day)).alias("weight"))


def capped(weights: DataFrame, most: float, least: float = 0.0) -> DataFrame:
    """Weights cut to `most`, scaled to 1, those under `least` dropped, scaled to 1 again."""
    day = Window.partitionBy("date")
    cut = weights.withColumn("weight", F.least("weight", F.lit(most)))
    cut = cut.withColumn("weight", F.col("weight") / F.sum("weight").over(day)).filter(F.col("weight") >= least)
    return cut.withColumn("weight", F.col("weight") / F.sum("weight").over(day))


def industry_capped(weights: DataFrame, industry: DataFrame, most: float) -> DataFrame:
    """Weights of industries above `most` scaled down to it, then all to 1; names without an industry are dropped."""
    known = weights.join(industry, "instrument")
    total = F.sum("weight").over(Window.partitionBy("date", "industry"))
    cut = known.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), F.lit(most) / total))
    return cut.select("date", "instrument", (F.col("weight") / F.sum("weight").over(Window.partitionBy("date"))).alias("weight"))


def drifted(prices: DataFrame, targets: DataFrame, hold: int) -> DataFrame:
    """i, date, instrument, weight, ret: weights set at every `hold`-th date and carried by prices between, with the next row's return.

    Within a block a weight is its target times the product of price ratios,
    made to sum to 1 on each date.
    """
    dates = prices.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    own = Window.partitionBy("instrument").orderBy("date")
    ratio = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(own)), F.lit(0.0))
    ret = F.coalesce(F.try_divide(F.lead("close").over(own), F.col("close")) - 1, F.lit(0.0))
    rows = prices.select("date", "instrument", ratio.alias("ratio"), ret.alias("ret")).join(F.broadcast(dates), "date").withColumn("block", F.floor(F.col("i") / hold)).join(targets, ["date", "instrument"], "left")
    block = Window.partitionBy("instrument", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.when(F.col("i") % hold == 0, F.coalesce("weight", F.lit(0.0))), ignorenulls=True).over(block)
    grown = F.product(F.when(F.col("i") % hold == 0, 1.0).otherwise(F.col("ratio"))).over(block)
    held = rows.withColumn("held", start * grown)
    return held.select("i", "date", "instrument", F.coalesce(F.try_divide(F.col("held"), F.sum("held").over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"), "ret")


def backtest(prices: DataFrame, targets: DataFrame, hold: int, cost: float = 0.0) -> DataFrame:
    """date, ret, nav, turnover; the turnover at a rebalance is half the change from the drifted weights and is paid for at its start."""
    held = drifted(prices, targets, hold)
    own = Window.partitionBy("instrument").orderBy("i")
    fresh = (F.col("i") % hold == 0) & (F.col("i") > 0)
    # What the last block's weights have become by the day of the next rebalance.
    carried = F.lag(F.col("weight") * (1 + F.col("ret"))).over(own)
    moved = held.withColumn("carried", carried).withColumn("before", F.coalesce(F.try_divide(F.col("carried"), F.sum("carried").over(Window.partitionBy("i"))), F.lit(0.0)))
    daily = moved.groupBy("i", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.sum(F.when(fresh, F.abs(F.col("weight") - F.col("before"))).otherwise(0.0)).alias("change"))
    net = daily.select("i", "date", (F.col("change") / 2).alias("turnover"), ((1 - F.col("change") / 2 * cost) * (1 + F.col("gross")) - 1).alias("ret"))
    return net.select("date", "ret", F.product(1 + F.col("ret")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("nav"), "turnover")


def metrics(daily: DataFrame, periods: int = 252, risk_free: float = 0.02, hold: int | None = None) -> DataFrame:
    """One row: total and annual return, volatility, Sharpe, largest drawdown, Calmar, win rate, mean turnover of (date, ret, nav, turnover).

    The last date has no return of its own and counts in none of the figures of
    returns. With `hold` the turnover is the mean over the rebalances, every
    hold-th date after the first.
    """
    every = Window.orderBy("date")  # one row per date
    peak = F.max("nav").over(every.rowsBetween(Window.unboundedPreceding, 0))
    placed = daily.withColumn("i", F.row_number().over(every) - 1).withColumn("down", F.col("nav") / peak - 1).withColumn("last", F.lead("date").over(every).isNull())
    moved = F.when((F.col("i") > 0) & (F.col("i") % hold == 0), F.col("turnover")) if hold else F.col("turnover")
    r = placed.withColumn("moved", moved).filter("not last or i = 0").agg(
        F.count("*").alias("n"), F.max_by("nav", "date").alias("nav"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"), F.min("down").alias("max_drawdown"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(F.avg("moved"), F.lit(0.0)).alias("avg_turnover")
    )
    annual = F.pow("nav", F.lit(float(periods)) / F.col("n")) - 1
    sharpe = F.try_divide((F.col("mean") - risk_free / periods) * periods**0.5, F.col("dev"))
    return r.select((F.col("nav") - 1).alias("total_return"), annual.alias("annual_return"), (F.col("dev") * periods**0.5).alias("volatility"), sharpe.alias("sharpe"), "max_drawdown", F.try_divide(annual, F.abs("max_drawdown")).alias("calmar"), "win_rate", "avg_turnover")


def turnover(weights: DataFrame) -> DataFrame:
    """date, turnover from the second date on: half the sum of changes, entries and exits included; 1 where no name is kept."""
    dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    old = weights.join(F.broadcast(dates), "date").filter("next is not null").select(F.col("next").alias("date"), "instrument", F.col("weight").alias("was"))
    new = weights.join(F.broadcast(dates.filter("next is not null").select(F.col("next").alias("date"))), "date", "left_semi")
    both = new.join(old, ["date", "instrument"], "full")
    daily = both.groupBy("date").agg(F.count_if(F.col("weight").isNotNull() & F.col("was").isNotNull()).alias("kept"), (F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("turnover"))
    return daily.select("date", F.when(F.col("kept") == 0, 1.0).otherwise(F.col("turnover")).alias("turnover"))


def on_grid(weights: DataFrame, grid: DataFrame, start: str | None = None) -> DataFrame:
    """Weights on every cell of a grid (date, instrument): a date's missing names are 0, dates without weights repeat the last ones; from `start` on."""
    known = weights.select("date").distinct().withColumn("set", F.lit(True))
    cells = grid.select("date", "instrument").join(F.broadcast(known), "date", "left").join(weights, ["date", "instrument"], "left")
    past = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(F.when(F.col("set"), F.coalesce("weight", F.lit(0.0))), ignorenulls=True).over(past), F.lit(0.0))
    out = cells.select("date", "instrument", filled.alias("weight"))
    return out.filter(F.col("date") >= start) if start else out


def screened(weights: DataFrame, excluded: DataFrame, most: float, least: float = 0.0) -> DataFrame:
    """Weights without the names of (instrument), scaled to 1, then cut by `capped`."""
    kept = weights.join(excluded.select("instrument").distinct(), "instrument", "left_anti")
    return capped(kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("date"))), most, least)


def risk_managed(
    weights: DataFrame, caps: DataFrame | None = None, flagged: DataFrame | None = None, industry: DataFrame | None = None,
    most: float = 0.05, least: float = 0.001, most_industry: float = 0.3, percentile: float = 0.0,
) -> DataFrame:
    """Weights (date, instrument, weight) under the limits of a risk manager, applied on each date in this order.

    Names whose cap (date, instrument, cap) lies below the linear `percentile` of
    the caps of the date's names go, names without a cap stay; then `flagged` names
    (date, instrument) go. Weights are cut to `most`, what is then under `least` or
    null goes, and the rest is made to sum to 1. Industries (instrument, industry)
    above `most_industry` are scaled down to it, once, and all to 1 again: where any
    name of a date is listed there, names that are not go, and a null industry has
    no limit. A date whose names all go has no rows.
    """
    day, cell = Window.partitionBy("date"), ["date", "instrument"]
    held = weights.select(*cell, "weight")
    if caps is not None and percentile > 0:
        valued = held.join(caps.select(*cell, "cap"), cell, "left").withColumn("edge", F.percentile("cap", F.lit(percentile)).over(day))
        held = valued.filter("cap is null or cap >= edge").select(*cell, "weight")
    if flagged is not None:
        held = held.join(flagged.select(*cell).distinct(), cell, "left_anti")
    share = F.col("weight") / F.sum("weight").over(day)
    cut = held.filter("weight is not null").withColumn("weight", F.least("weight", F.lit(most))).filter(F.col("weight") >= least).withColumn("weight", share)
    if industry is None:
        return cut
    known = cut.join(industry.select("instrument", "industry", F.lit(True).alias("listed")), "instrument", "left").withColumn("any", F.max("listed").over(day))
    total = F.sum("weight").over(Window.partitionBy("date", "industry"))
    bounded = F.when(F.col("industry").isNotNull() & (total > most_industry), F.col("weight") * most_industry / total).otherwise(F.col("weight"))
    return known.filter("listed or any is null").withColumn("weight", bounded).select(*cell, share.alias("weight"))


def return_metrics(daily: DataFrame, periods: int = 252, risk_free: float = 0.0) -> DataFrame:
    """One row from (date, ret, market): Sharpe, drawdown by product and by sum, Calmar, information ratio, win rate, Sortino, beta."""
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.product(1 + F.col("ret")).over(past)).withColumn("line", 1 + F.sum("ret").over(past))
    nav = nav.withColumn("down", F.col("nav") / F.max("nav").over(past) - 1).withColumn("simple", F.col("line") / F.max("line").over(past) - 1).withColumn("x", F.col("ret") - risk_free / periods).withColumn("over", F.col("ret") - F.col("market"))
    s = nav.agg(
        F.count("*").alias("n"), F.max_by("nav", "date").alias("nav"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev"), F.stddev_samp(F.when(F.col("x") < 0, F.col("x"))).alias("down_dev"), F.min("down").alias("max_drawdown"), F.min("simple").alias("simple_drawdown"),
        F.avg("over").alias("over"), F.stddev_samp("over").alias("over_dev"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.covar_samp("ret", "market").alias("cov"), F.var_pop("market").alias("var"),
    )
    root, zero = periods**0.5, F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    annual = F.pow("nav", F.lit(float(periods)) / F.col("n")) - 1
    return s.select(
        (ratio("mean", "dev") * root).alias("sharpe"), "max_drawdown", "simple_drawdown", ratio(annual, F.abs("max_drawdown")).alias("calmar"), (ratio("over", "over_dev") * root).alias("information_ratio"), "win_rate", (ratio("mean", "down_dev") * root).alias("sortino"), (F.col("cov") / (F.col("var") + 1e-8)).alias("beta"),
    )


def excess_nav(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """date, cumulative, market, excess from (date, nav) and (date, level): both against their first value, the benchmark filled forward, then backward."""
    every = Window.orderBy("date")
    ahead, behind = every.rowsBetween(Window.unboundedPreceding, 0), every.rowsBetween(0, Window.unboundedFollowing)
    level = F.coalesce(F.last("level", ignorenulls=True).over(ahead), F.first("level", ignorenulls=True).over(behind))
    both = nav.join(benchmark, "date", "left").withColumn("level", level)
    first = lambda c: F.first(c).over(ahead)
    return both.select("date", (F.col("nav") / first("nav") - 1).alias("cumulative"), (F.col("level") / first("level") - 1).alias("market")).withColumn("excess", F.col("cumulative") - F.col("market"))


def rebalance_dates(scores: DataFrame, universe: int) -> DataFrame:
    """The dates with scores of at least a tenth of the universe's names (one at least); where there is none, those with any."""
    daily = scores.filter("score is not null").groupBy("date").agg(F.count("*").alias("n"))
    enough = daily.filter(F.col("n") >= max(1, universe // 10)).select("date")
    return daily.select("date") if enough.isEmpty() else enough


def build(scores: DataFrame, n: int, suspended: DataFrame | None = None, proportional: bool = False) -> DataFrame:
    """date, instrument, weight: the n best scores of each date but for suspended names (date, instrument); n is at most the number of scores before these go, and dates with fewer left are skipped."""
    day = Window.partitionBy("date")
    known = scores.filter("score is not null").withColumn("_n", F.least(F.lit(n), F.count("*").over(day)))
    free = known.join(suspended.select("date", "instrument"), ["date", "instrument"], "left_anti") if suspended is not None else known
    full = free.withColumn("_m", F.count("*").over(day)).filter(F.col("_m") >= F.col("_n"))
    return top_n(full.select("date", "instrument", "score"), n, proportional)


#: Names of weightings; any other is by score.
WEIGHTINGS = {"equal": False, "equal_weight": False, "score": True, "score_weighted": True, "proportional": True}


def weighted(scores: DataFrame, n: int, how: str = "score", most: float | None = None, least: float = 0.0) -> DataFrame:
    weights = top_n(scores, n, WEIGHTINGS.get(how, True))
    return weights if most is None else capped(weights, most, least)


def held_returns(weights: DataFrame, panel: DataFrame, least: int = 3) -> DataFrame:
    """date, ret: what weights set on a date return until the next such date, over names priced on both, the weights made to sum to 1; dates with fewer than `least` such names are left out."""
    dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    prices = panel.filter("close is not null").select("date", "instrument", "close")
    now = weights.join(dates.filter("next is not null"), "date").join(prices, ["date", "instrument"])
    both = now.join(prices.select(F.col("date").alias("next"), "instrument", F.col("close").alias("then")), ["next", "instrument"])
    daily = both.groupBy("date").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("weight") * (F.try_divide("then", "close") - 1)), F.sum("weight")).alias("ret"))
    return daily.filter(F.col("n") >= least).select("date", "ret")


def simple_performance(weights: DataFrame, panel: DataFrame, periods: int = 252) -> DataFrame:
    """One row of held_returns(), rounded to four places: total and annual return and volatility, their ratio, the size of the largest drawdown, Calmar, win rate, mean turnover, numbers of returns and of portfolios."""
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    r = held_returns(weights, panel).withColumn("nav", F.product(1 + F.col("ret")).over(past)).withColumn("down", F.col("nav") / F.max("nav").over(past) - 1)
    s = r.agg(F.count("*").alias("n_periods"), F.max_by("nav", "date").alias("nav"), F.stddev_samp("ret").alias("dev"), F.abs(F.min("down")).alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    moved = turnover(weights).agg(F.sum("turnover").alias("moved")).join(weights.agg(F.count_distinct("date").alias("n_portfolios")))
    annual, vol = F.pow("nav", F.lit(float(periods)) / F.col("n_periods")) - 1, F.col("dev") * periods**0.5
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = {"total_return": F.col("nav") - 1, "annual_return": annual, "volatility": vol, "sharpe": ratio(annual, vol), "max_drawdown": F.col("max_drawdown"), "calmar": ratio(annual, F.col("max_drawdown")), "win_rate": F.col("win_rate"), "avg_turnover": ratio(F.col("moved"), F.col("n_portfolios"))}
    return s.join(moved).select(*[F.round(c, 4).alias(k) for k, c in out.items()], "n_periods", "n_portfolios")

"""Reports on many factors at once.

Exposures are long: (factor, date, instrument, value, target). Every report is
a few windows and aggregates over (factor, date), so the number of factors,
dates and names only adds rows. Cells with a null on either side are left out
unless said; an undefined figure is null, and an undefined day is not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ("factor", "date")


def places(x: str, *keys: str) -> Column:
    """Places from 1 of the known cells within the keys, ties at their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(Window.partitionBy(*keys, F.col(x).isNull()).orderBy(x)) + (ties - 1) / 2)


def correlation(a: str, b: str) -> Column:
    """Pearson over a group, null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def paired(exposures: DataFrame) -> DataFrame:
    return exposures.filter("value is not null and target is not null")


def ic_matrix(exposures: DataFrame) -> DataFrame:
    """factor, date, ic: both sides ranked over their own known cells and centred; the product over common cells, the sizes over their own."""
    day = Window.partitionBy(*DAY)
    ranked = exposures.select(*DAY, places("value", *DAY).alias("f"), places("target", *DAY).alias("t"))
    centred = ranked.select(*DAY, (F.col("f") - F.avg("f").over(day)).alias("f"), (F.col("t") - F.avg("t").over(day)).alias("t"))
    size = F.sqrt(F.sum(F.col("f") * F.col("f"))) * F.sqrt(F.sum(F.col("t") * F.col("t")))
    return centred.groupBy(*DAY).agg(F.try_divide(F.sum(F.col("f") * F.col("t")), size).alias("ic")).filter("ic is not null")


def paired_ic(exposures: DataFrame, least: int = 3) -> DataFrame:
    """factor, date, n, spearman, pearson, sample_spearman (the covariance over n, the deviations over n - 1) over common cells of days with at least `least`."""
    ranked = paired(exposures).select(*DAY, "value", "target", places("value", *DAY).alias("f"), places("target", *DAY).alias("t"))
    daily = ranked.groupBy(*DAY).agg(F.count("*").alias("n"), correlation("f", "t").alias("spearman"), correlation("value", "target").alias("pearson")).filter(F.col("n") >= least)
    return daily.withColumn("sample_spearman", F.col("spearman") * (F.col("n") - 1) / F.col("n"))


def ic_summary(daily: DataFrame, ic: str = "spearman", least_days: int = 20) -> DataFrame:
    """factor, days, mean_ic, ir (sample deviation), icir (population deviation, 0 under `least_days` days, at most 2 where the deviation vanishes) and win_rate."""
    s = daily.filter(F.col(ic).isNotNull()).groupBy("factor").agg(F.count("*").alias("days"), F.avg(ic).alias("mean_ic"), F.stddev_samp(ic).alias("dev"), F.stddev_pop(ic).alias("spread"), F.avg((F.col(ic) > 0).cast("double")).alias("win_rate"))
    steady = F.when(F.abs("mean_ic") > 0.01, 2.0 * F.signum("mean_ic")).otherwise(0.0)
    icir = F.when(F.col("days") < least_days, 0.0).when(F.col("spread") < 1e-6, steady).otherwise(F.try_divide("mean_ic", "spread"))
    return s.select("factor", "days", "mean_ic", F.try_divide("mean_ic", "dev").alias("ir"), icir.alias("icir"), "win_rate")


def masked_ic(exposures: DataFrame) -> DataFrame:
    """factor, date, ic on every day: population moments over common cells, a deviation under 1e-3 leaves the covariance undivided, a day without cells is 0."""
    both = F.col("value").isNotNull() & F.col("target").isNotNull()
    v, t = F.when(both, F.col("value")), F.when(both, F.col("target"))
    daily = exposures.groupBy(*DAY).agg(F.covar_pop(v, t).alias("cov"), F.stddev_pop(v).alias("sv"), F.stddev_pop(t).alias("st"))
    size = F.when((F.col("sv") < 1e-3) | (F.col("st") < 1e-3), 1.0).otherwise(F.col("sv") * F.col("st"))
    return daily.select(*DAY, F.coalesce(F.col("cov") / size, F.lit(0.0)).alias("ic"))


def rolling_icir(daily: DataFrame, ic: str = "spearman", n: int = 20) -> DataFrame:
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(1 - n, 0)
    return daily.select(*DAY, F.when(F.count(ic).over(w) == n, F.avg(ic).over(w) / (F.stddev_samp(ic).over(w) + 1e-8)).alias("icir"))


def select_walk_forward(daily: DataFrame, least_ic: float = 0.02, least_ir: float = 0.2, n: int = 20, ic: str = "spearman") -> DataFrame:
    """factor, date, mean_ic, ir of each date's chosen factors: past means and ratios beyond both limits in size; where there is none, the factor of the largest mean."""
    w = Window.partitionBy("factor").orderBy("date").rowsBetween(-n, -1)
    mean, dev = F.avg(ic).over(w), F.stddev_samp(ic).over(w)
    past = daily.select(*DAY, mean.alias("mean_ic"), F.try_divide(mean, dev).alias("ir")).filter("mean_ic is not null")
    good = (F.abs("mean_ic") > least_ic) & (F.abs("ir") > least_ir)
    day = Window.partitionBy("date")
    place = F.row_number().over(day.orderBy(F.desc(F.abs("mean_ic")), "factor"))
    judged = past.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("any", F.max("good").over(day)).withColumn("place", place)
    return judged.filter("good or (not any and place = 1)").select(*DAY, "mean_ic", "ir")


def _binned(cells: DataFrame, k: int, least: int, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Cells with their quantile bin from 0: linear edges, equal edges dropped; groups under `least` cells or without two edges go."""
    levels = F.array(*[F.lit(float(q)) for q in _levels(k)])
    edges = cells.groupBy(*keys).agg(F.count("*").alias("_n"), F.array_sort(F.array_distinct(F.percentile("value", levels))).alias("_e")).filter((F.col("_n") >= least) & (F.size("_e") > 1))
    inner = F.expr("slice(_e, 2, greatest(size(_e) - 2, 0))")
    return cells.join(edges, list(keys)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("value")))).drop("_n", "_e")


def _levels(k: int) -> list[float]:
    """k + 1 evenly spaced levels, each a multiple of the step."""
    return [i * (1 / k) for i in range(k)] + [1.0]


def quantile_returns(exposures: DataFrame, k: int = 5) -> DataFrame:
    """factor, bin, mean_return: the mean over days of each bin's mean target, 0 for a bin without days; days with at least 2k names."""
    daily = _binned(paired(exposures), k, 2 * k).groupBy(*DAY, "bin").agg(F.avg("target").alias("r"))
    bins = exposures.select("factor").distinct().select("factor", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("bin"))
    return bins.join(daily, ["factor", "bin"], "left").groupBy("factor", "bin").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_return"))


def monotonicity(returns: DataFrame) -> DataFrame:
    """factor, monotonicity: the larger share of rising or falling steps from bin to bin."""
    step = F.col("mean_return") - F.lag("mean_return").over(Window.partitionBy("factor").orderBy("bin"))
    share = F.greatest(F.sum((F.col("step") > 0).cast("int")), F.sum((F.col("step") < 0).cast("int"))) / F.count("step")
    return returns.withColumn("step", step).groupBy("factor").agg(share.alias("monotonicity"))


def _with_before(exposures: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell with the same name's columns on the factor's date before, as `was_...`; only names that have both."""
    dates = exposures.select(*DAY).distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    at = exposures.join(dates, list(DAY))
    before = at.select("factor", "instrument", (F.col("i") + 1).alias("i"), *[F.col(c).alias(f"was_{c}") for c in columns])
    return at.join(before, ["factor", "instrument", "i"])


def top_turnover(exposures: DataFrame, k: int = 5) -> DataFrame:
    """factor, date, turnover: 1 less the overlap over the union of the top bins of two dates, both binned over their common names."""
    both = _with_before(exposures.select(*DAY, "instrument", "value"), ["value"]).filter("value is not null and was_value is not null").select(*DAY, "instrument", "value", "was_value")
    now = _binned(both, k, 2 * k).withColumnRenamed("bin", "now").select(*DAY, "instrument", "now", F.col("was_value").alias("value"))
    then = _binned(now, k, 2 * k)
    is_now, was = F.col("now") == k - 1, F.col("bin") == k - 1
    daily = then.groupBy(*DAY).agg(F.count_if(is_now & was).alias("both"), F.count_if(is_now | was).alias("any"))
    return daily.filter("any > 0").select(*DAY, (1 - F.col("both") / F.col("any")).alias("turnover"))


def end_turnover(exposures: DataFrame, share: float = 0.2) -> DataFrame:
    """factor, date, turnover: the mean share of the last date's top and bottom names that left them; days whose top is empty go."""
    ranked = exposures.withColumn("r", places("value", *DAY) / F.count("value").over(Window.partitionBy(*DAY)))
    dates = ranked.select(*DAY).distinct().withColumn("next", F.lead("date").over(Window.partitionBy("factor").orderBy("date")))
    ends = ranked.select(*DAY, "instrument", (F.col("r") >= 1 - share).alias("top"), (F.col("r") <= share).alias("low")).filter("top or low")
    left = ends.join(dates, list(DAY)).filter("next is not null").alias("a").join(ends.alias("b"), F.expr("a.factor = b.factor and a.next = b.date and a.instrument = b.instrument"), "left")
    gone = left.groupBy(F.col("a.factor").alias("factor"), F.col("a.next").alias("date")).agg(
        F.try_divide(F.count_if(F.expr("a.top and not coalesce(b.top, false)")), F.count_if("a.top")).alias("top"), F.try_divide(F.count_if(F.expr("a.low and not coalesce(b.low, false)")), F.count_if("a.low")).alias("low")
    )
    has_top = ends.filter("top").select(*DAY).distinct()
    return gone.join(has_top, list(DAY), "left_semi").filter("top is not null").select(*DAY, ((F.col("top") + F.coalesce("low", F.lit(0.0))) / 2).alias("turnover"))


def spread_returns(exposures: DataFrame, n: int = 50) -> DataFrame:
    """factor, date, ret: mean target of the n greatest less that of the n least values, on days with at least 2n names; ties by instrument."""
    day = Window.partitionBy(*DAY)
    ends = paired(exposures).select(*DAY, "target", F.row_number().over(day.orderBy(F.desc("value"), "instrument")).alias("top"), F.row_number().over(day.orderBy("value", "instrument")).alias("low"), F.count("*").over(day).alias("m")).filter(F.col("m") >= 2 * n)
    return ends.groupBy(*DAY).agg((F.avg(F.when(F.col("top") <= n, F.col("target"))) - F.avg(F.when(F.col("low") <= n, F.col("target")))).alias("ret"))


def spread_stats(spreads: DataFrame, periods: int = 252, least_days: int = 20) -> DataFrame:
    """factor, days, sharpe, volatility, max_drawdown (as a positive share) of spread returns; 0 under `least_days` days."""
    past = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = spreads.withColumn("nav", F.product(1 + F.col("ret")).over(past))
    s = nav.withColumn("down", F.col("nav") / F.max("nav").over(past) - 1).groupBy("factor").agg(F.count("*").alias("days"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"), F.min("down").alias("down"))
    enough = lambda c: F.when(F.col("days") < least_days, 0.0).otherwise(c)
    root = periods**0.5
    return s.select("factor", "days", enough(F.coalesce(F.try_divide("mean", "dev") * root, F.lit(0.0))).alias("sharpe"), enough(F.col("dev") * root).alias("volatility"), enough(F.abs("down")).alias("max_drawdown"))


def factor_report(exposures: DataFrame, n: int = 50, periods: int = 252) -> DataFrame:
    """One row per factor: IC, ICIR, win rate, spread statistics, monotonicity and turnover."""
    parts = [
        ic_summary(paired_ic(exposures, 10)), spread_stats(spread_returns(exposures, n), periods).drop("days"), monotonicity(quantile_returns(exposures)), top_turnover(exposures).groupBy("factor").agg(F.avg("turnover").alias("turnover")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "factor", "left")
    return out


def factor_pairs(exposures: DataFrame, least: int = 3) -> DataFrame:
    """a, b, days, rho, rho_size: the mean daily Spearman and its mean size for each pair of factors (a < b) over common names; one row per pair and cell is shuffled."""
    left = exposures.filter("value is not null").select("date", "instrument", F.col("factor").alias("a"), F.col("value").alias("x"))
    both = left.join(left.select("date", "instrument", F.col("a").alias("b"), F.col("x").alias("y")), ["date", "instrument"]).filter("a < b")
    keys = ("a", "b", "date")
    ranked = both.select(*keys, places("x", *keys).alias("x"), places("y", *keys).alias("y"))
    daily = ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("x", "y").alias("rho")).filter((F.col("n") >= least) & F.col("rho").isNotNull())
    return daily.groupBy("a", "b").agg(F.count("*").alias("days"), F.avg("rho").alias("rho"), F.avg(F.abs("rho")).alias("rho_size"))


def pooled_pairs(exposures: DataFrame, least: int = 100) -> DataFrame:
    """a, b, rho: the size of the correlation of percentile ranks over all dates at once; 0 under `least` common cells."""
    ranks = exposures.filter("value is not null").select("date", "instrument", "factor", (places("value", *DAY) / F.count("value").over(Window.partitionBy(*DAY))).alias("r"))
    left = ranks.select("date", "instrument", F.col("factor").alias("a"), F.col("r").alias("x"))
    both = left.join(left.select("date", "instrument", F.col("a").alias("b"), F.col("x").alias("y")), ["date", "instrument"]).filter("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.abs(correlation("x", "y")).alias("c")).select("a", "b", F.when(F.col("n") >= least, F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("rho"))


def diversity(pairs: DataFrame, least_days: int = 20) -> DataFrame:
    """factor, diversity: 1 less the largest mean size of correlation with any other factor."""
    known = pairs.filter(F.col("days") >= least_days)
    ends = known.select(F.col("a").alias("factor"), "rho_size").unionByName(known.select(F.col("b").alias("factor"), "rho_size"))
    return ends.groupBy("factor").agg((1 - F.max("rho_size")).alias("diversity"))


def overfitting(exposures: DataFrame, split: str, least_rows: int = 50) -> DataFrame:
    """factor, overfitting, decay: scores of the IC and of the ICIR from `split` on against those before; 0.5 and 1 under `least_rows` cells on a side."""
    rows = exposures.groupBy("factor").agg(F.count_if(F.col("date") < split).alias("n_in"), F.count_if(F.col("date") >= split).alias("n_out"))
    daily = paired_ic(exposures, 3)
    side = lambda where, suffix: ic_summary(daily.filter(where)).select("factor", F.col("mean_ic").alias(f"ic_{suffix}"), F.col("icir").alias(f"icir_{suffix}"))
    s = rows.join(side(F.col("date") < split, "in"), "factor", "left").join(side(F.col("date") >= split, "out"), "factor", "left").na.fill(0.0, ["ic_in", "ic_out", "icir_in", "icir_out"])
    a, b = F.col("ic_in"), F.col("ic_out")
    ratio = F.when(a * b > 0, F.least(F.lit(1.5), F.try_divide(F.abs(b), F.abs(a)))).otherwise(-0.5)
    # Limits of the ratio and the scores at them.
    shape = F.when(ratio > 1, 0.8 + 0.1 * F.least(ratio - 1, F.lit(0.5))).when(ratio > 0.8, 0.7 + 0.3 * (ratio - 0.8) / 0.2).when(ratio > 0.5, 0.4 + 0.3 * (ratio - 0.5) / 0.3).when(ratio > 0, 0.2 + 0.2 * ratio / 0.5).otherwise(0.1)
    few = (F.col("n_in") < least_rows) | (F.col("n_out") < least_rows)
    score = F.when(few, 0.5).when(F.abs(a) <= 0.001, F.when(F.abs(b) <= 0.001, 0.5).otherwise(0.3)).otherwise(shape)
    c, d = F.col("icir_in"), F.col("icir_out")
    decay = F.when(few, 1.0).when(F.abs(c) < 0.1, F.when(F.abs(d) < 0.1, 1.0).otherwise(0.5)).otherwise(F.try_divide(d, c))
    return s.select("factor", score.alias("overfitting"), decay.alias("decay"))


def mean_return_correlation(returns: DataFrame, least: int = 10) -> DataFrame:
    """One row, correlation: the mean Pearson over all pairs of instruments known on every date, from (date, instrument, ret); 0 under `least` dates.

    The standardised rows of m instruments sum to S on a date; the mean over
    pairs is (sum of S squared / dates - m) / (m (m - 1)), so no pair is made.
    """
    n = returns.agg(F.count_distinct("date").alias("n"))
    own = Window.partitionBy("instrument")
    whole = returns.withColumn("k", F.count("ret").over(own)).crossJoin(F.broadcast(n)).filter("k = n").withColumn("z", F.try_divide(F.col("ret") - F.avg("ret").over(own), F.stddev_pop("ret").over(own))).filter("z is not null")
    daily = whole.groupBy("date").agg(F.sum("z").alias("s"), F.count("*").alias("m"))
    total = daily.agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("m").alias("m"), F.count("*").alias("n"))
    mean = F.try_divide(F.col("q") / F.col("n") - F.col("m"), F.col("m") * (F.col("m") - 1))
    return total.select(F.when(F.col("n") >= least, F.coalesce(mean, F.lit(0.0))).otherwise(0.0).alias("correlation"))


def describe(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, dev (population) of each numeric column over runs."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("c")).select("c.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))


def weighted_score(rounds: DataFrame) -> DataFrame:
    """factor, score: the mean of its rounds' scores (factor, round from 0, score) by weights (round + 1) / rounds."""
    w = (F.col("round") + 1) / F.count("*").over(Window.partitionBy("factor"))
    return rounds.withColumn("w", w).groupBy("factor").agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("score"))


def family_balanced(factors: DataFrame, n: int, cap: int | None = None) -> DataFrame:
    """The n best factors (factor, family, icir): the best of each family first, then by size of ICIR; with a cap, at most that many of a family."""
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc(F.abs("icir")), "factor"))
    placed = factors.withColumn("place", place)
    kept = placed.filter(F.col("place") <= cap) if cap else placed
    return kept.orderBy(F.when(F.col("place") == 1, 0).otherwise(1), F.desc(F.abs("icir")), "factor").limit(n).drop("place")

"""Choosing factors: gates, best ones of a group, tournaments, relative scores, and comparison of factors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators import reports


def finite(x: Column | str) -> Column:
    """Null for an infinite value or NaN."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tradeable(scores: DataFrame, panel: DataFrame, least: int = 1) -> DataFrame:
    """The scores of names that have a price on the date; dates with fewer than `least` of them are left out."""
    priced = scores.join(panel.filter("close is not null").select("date", "instrument"), ["date", "instrument"], "left_semi")
    return priced.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") >= least).drop("_n")


def quality_gate(factors: DataFrame, least_ic: float = 0.0, least_val_ic: float | None = None, least_sharpe: float | None = None, worst_drawdown: float | None = None) -> DataFrame:
    """The factors (factor, ic, val_ic, val_sharpe, sharpe, max_drawdown) that pass; where none does, the one of the best IC (that of validation if it is judged).

    With a limit for the validation IC the Sharpe ratio is that of validation where
    there is one. Drawdowns are negative.
    """
    sharpe = F.coalesce("val_sharpe", "sharpe") if least_val_ic is not None else F.col("sharpe")
    tests = [F.col("ic") >= least_ic]
    tests += [F.col("val_ic") >= least_val_ic] if least_val_ic is not None else []
    tests += [sharpe >= least_sharpe] if least_sharpe is not None else []
    tests += [F.col("max_drawdown") >= worst_drawdown] if worst_drawdown is not None else []
    good = F.lit(True)
    for t in tests:
        good = good & F.coalesce(t, F.lit(False))
    every = Window.partitionBy(F.lit(0))  # one row per factor
    place = F.row_number().over(every.orderBy(F.desc_nulls_last("val_ic" if least_val_ic is not None else "ic"), "factor"))
    judged = factors.withColumns({"_good": good, "_place": place}).withColumn("_any", F.max("_good").over(every))
    return judged.filter("_good or (not _any and _place = 1)").drop("_good", "_place", "_any")


def best(factors: DataFrame, k: int, by: str = "ic") -> DataFrame:
    """The k factors of the largest size of a figure, ties by name."""
    return factors.orderBy(F.desc_nulls_last(F.abs(by)), "factor").limit(k)


def best_of_groups(factors: DataFrame, k: int, group: str = "cluster", by: str = "ic") -> DataFrame:
    """The factors with their place (from 1) among the k of the largest size of a figure in each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(F.abs(by)), "factor"))
    return factors.withColumn("place", place).filter(F.col("place") <= k)


#: Weights of the sizes of a factor's figures, and of what drawdown and turnover leave of 1, in a tournament.
MERITS, LOSSES = {"icir": 0.25, "sharpe": 0.20, "mean_ic": 0.10, "win_rate": 0.10, "monotonicity": 0.10, "spread": 10.0}, {"max_drawdown": 0.10, "turnover": 0.05}


def champion(factors: DataFrame) -> DataFrame:
    """The factor of the largest merit; of equal ones that of the least size of ICIR (then by name), which holds its place against later ones."""
    merit = sum((w * F.abs(F.coalesce(c, F.lit(0.0))) for c, w in MERITS.items()), F.lit(0.0)) + sum((w * (1 - F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0))) for c, w in LOSSES.items()), F.lit(0.0))
    return factors.withColumn("score", F.round(merit, 12)).orderBy(F.desc("score"), F.abs("icir"), "factor").limit(1)


def clusters(ic: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """factor, cluster: k-means of the factors' daily IC profiles (factor, date, ic), unknown days as 0; a profile has one figure for each date of the calendar."""
    days = ic.select("date").distinct()
    full = ic.select("factor").distinct().join(days).join(ic, ["factor", "date"], "left")
    profiles = full.groupBy("factor").agg(F.sort_array(F.collect_list(F.struct("date", F.coalesce("ic", F.lit(0.0)).alias("ic")))).alias("p")).select("factor", array_to_vector(F.transform("p", lambda x: x["ic"])).alias("features"))
    return KMeans(k=k, seed=seed).fit(profiles).transform(profiles).select("factor", F.col("prediction").alias("cluster"))


#: From which figure on a score is given while few factors are known, and the score below all of them.
COLD = {"ic": ((0.05, 0.9), (0.03, 0.7), (0.01, 0.5), (0.0, 0.3)), "ir": ((1.0, 0.9), (0.5, 0.7), (0.2, 0.5), (0.0, 0.3)), "turnover": ((0.2, 0.9), (0.4, 0.7), (0.6, 0.5), (0.8, 0.3))}
WORST = 0.1


def _cold(metric: str) -> Column:
    if metric == "diversity":
        return F.greatest(F.lit(0.8), F.col(metric))
    x, out = F.col(metric), F.lit(WORST)
    for limit, score in reversed(COLD[metric]):
        out = F.when(x <= limit if metric == "turnover" else x >= limit, score).otherwise(out)
    return out


def relative_scores(candidates: DataFrame, repository: DataFrame, least: int = 10) -> DataFrame:
    """factor and a score from 0 to 10 for ic, ir, turnover and diversity: the share of the repository that is strictly worse; while it has fewer than `least` factors, scores from a table.

    Each metric of the repository is counted by value once, and candidates are
    put among these counts by a window over both, so no pair is made.
    """
    metrics = ("ic", "ir", "turnover", "diversity")
    n = repository.count()  # one row per factor
    if n < least:
        return candidates.select("factor", *[(_cold(m) * 10).alias(m) for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (-F.col(m) if m == "turnover" else F.col(m)).alias("v")) for m in metrics])).alias("x")
    known = repository.select(F.lit(None).cast("string").alias("factor"), rows).select("factor", "x.*", F.lit(1).alias("one"))
    asked = candidates.select("factor", rows).select("factor", "x.*", F.lit(0).alias("one"))
    below = F.sum("one").over(Window.partitionBy("metric").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)) - F.sum("one").over(Window.partitionBy("metric", "v"))
    scored = known.union(asked).withColumn("score", below / n * 10).filter("factor is not null")
    return scored.groupBy("factor").agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])


def normalised_scores(scores: DataFrame) -> DataFrame:
    """factor and the five figures drawn to 0..1: the IC by pieces, the ICIR by a hyperbolic tangent, the others by powers."""
    ic, icir, unit = F.col("effectiveness"), F.col("stability"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    # Places of the IC and what they are drawn to.
    knots, value = ((-0.2, 0.0), (-0.05, 0.2), (0.0, 0.5), (0.05, 0.8), (0.2, 1.0)), F.lit(1.0)
    for (a, x), (b, y) in reversed(list(zip(knots, knots[1:], strict=False))):
        value = F.when(ic <= b, x + (ic - a) / (b - a) * (y - x)).otherwise(value)
    tanh = F.when(icir <= -5, 0.0).when(icir >= 5, 1.0).otherwise((F.tanh(icir / 5 * 1.5) + 1) / 2)
    return scores.select("factor", F.when(ic <= -0.2, 0.0).otherwise(value).alias("effectiveness"), tanh.alias("stability"), unit(F.sqrt("turnover")).alias("turnover"), unit(F.col("diversity")).alias("diversity"), unit(F.pow("overfitting", F.lit(0.7))).alias("overfitting"))


def five_scores(exposures: DataFrame, split: str, least_rows: int = 100) -> DataFrame:
    """factor, effectiveness (mean IC), stability (ICIR), turnover (of ranks, 1 is steady), diversity and overfitting; factors with fewer than `least_rows` common cells are left out."""
    enough = reports.paired(exposures).groupBy("factor").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows).select("factor")
    kept = exposures.join(enough, "factor", "left_semi")
    s = reports.ic_summary(reports.paired_ic(kept)).select("factor", F.col("mean_ic").alias("effectiveness"), F.col("icir").alias("stability"))
    ranked = kept.select("factor", "date", "instrument", (reports.places("value", *reports.DAY) / F.count("value").over(Window.partitionBy(*reports.DAY))).alias("value"))
    dates = ranked.select("factor", "date").distinct().withColumn("i", F.row_number().over(Window.partitionBy("factor").orderBy("date")))
    at = ranked.join(dates, ["factor", "date"])
    moved = at.join(at.select("factor", "instrument", (F.col("i") + 1).alias("i"), F.col("value").alias("was")), ["factor", "instrument", "i"]).filter("value is not null and was is not null")
    daily = moved.groupBy("factor", "date").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("was"))).alias("d")).filter("n >= 3")
    steady = daily.groupBy("factor").agg((1 - F.avg("d")).alias("turnover"))
    out = s.join(steady, "factor", "left").join(reports.diversity(reports.factor_pairs(kept)), "factor", "left").join(reports.overfitting(kept, split).select("factor", "overfitting"), "factor", "left")
    return out.na.fill(1.0, ["diversity"])


def equal_factors(a: DataFrame, b: DataFrame, tolerance: float = 1e-6, overlap: float = 0.99) -> DataFrame:
    """One row: how two factors (date, instrument, value) agree: rows_alike (ratio of their row counts), cells_alike (shared cells over all), missing_alike, values_alike (share of shared known cells within the tolerance) and equal."""
    x, y = a.select("date", "instrument", F.col("value").alias("x"), F.lit(1).alias("in_x")), b.select("date", "instrument", F.col("value").alias("y"), F.lit(1).alias("in_y"))
    both = x.join(y, ["date", "instrument"], "full")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    n, m, shared = F.count("in_x"), F.count("in_y"), F.count_if(F.col("in_x").isNotNull() & F.col("in_y").isNotNull())
    s = both.agg(
        F.try_divide(F.least(n, m), F.greatest(n, m)).alias("rows_alike"), F.try_divide(shared, F.count("*")).alias("cells_alike"),
        (F.count_if(F.col("in_x").isNotNull() & F.col("x").isNull()) == F.count_if(F.col("in_y").isNotNull() & F.col("y").isNull())).alias("missing_alike"),
        F.try_divide(F.count_if(known & (F.abs(F.col("x") - F.col("y")) <= tolerance)), F.count_if(known)).alias("values_alike"),
    )
    same = (F.col("rows_alike") >= overlap) & (F.col("cells_alike") >= overlap) & F.col("missing_alike") & (F.coalesce("values_alike", F.lit(1.0)) == 1)
    return s.withColumn("equal", F.coalesce(same, F.lit(False)))


def united(pools: list[DataFrame], key: str = "expression") -> DataFrame:
    """Candidates of several pools (with key and score), one of each expression: that of the earliest pool."""
    marked = [p.withColumn("_pool", F.lit(i)) for i, p in enumerate(pools)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    order = F.struct("_pool", F.to_json(F.struct(*[c for c in every.columns if c != "_pool"])))
    return every.groupBy(key).agg(F.min_by(F.struct(*every.columns), order).alias("_r")).select("_r.*").drop("_pool")


def numbered(factors: DataFrame, key: str = "factor") -> DataFrame:
    """Names that stand several times get __dup1, __dup2, ... from the second on, in the order of the remaining columns."""
    rest = [c for c in factors.columns if c != key]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*rest)) - 1
    return factors.withColumn("_n", place).withColumn(key, F.when(F.col("_n") > 0, F.concat(key, F.lit("__dup"), "_n")).otherwise(F.col(key))).drop("_n")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order, in that order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n").orderBy(order)


def fitness(cells: DataFrame) -> DataFrame:
    """factor and the weighted figures of predictions (factor, y, predicted, w): pearson and spearman (sizes), mae, mse, rmse, log_loss. Undefined correlations are 0; rows with a null are left out."""
    known = cells.na.drop(subset=["y", "predicted", "w"]).select("factor", "y", "predicted", "w", reports.places("y", "factor").alias("ry"), reports.places("predicted", "factor").alias("rp"))
    total = F.sum("w")
    mean = lambda x: F.sum(F.col("w") * x) / total

    def corr(a: str, b: str) -> Column:
        x, y = F.col(a), F.col(b)
        cov = mean(x * y) - mean(x) * mean(y)
        size = F.sqrt(F.greatest((mean(x * x) - mean(x) * mean(x)) * (mean(y * y) - mean(y) * mean(y)), F.lit(0.0)))
        return F.coalesce(F.abs(F.try_divide(cov, size)), F.lit(0.0))

    eps = 1e-15
    inside = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col("y") * F.ln(inside(F.col("predicted"))) + (1 - F.col("y")) * F.ln(inside(1 - F.col("predicted"))))
    off = F.col("predicted") - F.col("y")
    return known.groupBy("factor").agg(corr("y", "predicted").alias("pearson"), corr("ry", "rp").alias("spearman"), mean(F.abs(off)).alias("mae"), mean(off * off).alias("mse"), F.sqrt(mean(off * off)).alias("rmse"), mean(loss).alias("log_loss"))

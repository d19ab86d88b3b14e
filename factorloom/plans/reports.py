"""Queries of the factor reports, the fusion of factors and portfolio figures, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import fusion, portfolio, reports
from factorloom.plans.queries import _O, _panel, _targets, backtest
from factorloom.sources import panels


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors of brands and months in long form with the five-month return as target."""
    dense = panels.densify(panels.brand_panel(spark, sf_dir))
    wide = dense.select("date", "instrument", (F.try_divide("close", F.lag("close", 3).over(Window.partitionBy("instrument").orderBy("date"))) - 1).alias("momentum"), F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("reach"), F.col("volume").alias("volume"), panels.forward_return(5).alias("target"))
    return wide.unpivot(["date", "instrument", "target"], ["momentum", "reach", "volume"], "factor", "value").select("factor", "date", "instrument", "value", "target")


_PLACE = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {k}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 END"


def _place(x: str, k: str = "factor, date") -> str:
    return _PLACE.format(x=x, k=k)


_LONG = f"""{_panel('brand')}, wide AS (SELECT date, instrument, close / nullif(lag(close, 3) OVER {_O}, 0) - 1 AS momentum, (high - low) / nullif(close, 0) AS reach, volume, lead(close, 5) OVER {_O} / nullif(close, 0) - 1 AS target FROM g),
    x AS (SELECT 'momentum' AS factor, date, instrument, momentum AS value, target FROM wide UNION ALL SELECT 'reach', date, instrument, reach, target FROM wide UNION ALL SELECT 'volume', date, instrument, volume, target FROM wide),
    known AS (SELECT * FROM x WHERE value IS NOT NULL AND target IS NOT NULL)"""
_CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
_PAIRED = f"""{_LONG}, rk AS (SELECT *, {_place('value')} AS f, {_place('target')} AS t FROM known),
    ic AS (SELECT factor, date, count(*) AS n, {_CORR.format(a='f', b='t')} AS spearman, {_CORR.format(a='value', b='target')} AS pearson FROM rk GROUP BY factor, date HAVING count(*) >= {{least}})"""
_BINS = """e AS (SELECT factor, date, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]))) AS e FROM {t} GROUP BY factor, date HAVING count(*) >= 10),
    bins AS (SELECT {t}.*, len(list_filter(e[2:-2], lambda v: v < value)) AS bin FROM {t} JOIN e USING (factor, date) WHERE len(e) > 1)"""


def _round(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if c in names else c for c in frame.columns])


def ic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.ic_matrix(exposures(spark, sf_dir)), "ic")


def paired_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.paired_ic(exposures(spark, sf_dir), 10), "spearman", "pearson", "sample_spearman")


def ic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.ic_summary(reports.paired_ic(exposures(spark, sf_dir), 10)), "mean_ic", "ir", "icir", "win_rate")


def masked_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.masked_ic(exposures(spark, sf_dir)), "ic")


def rolling_icir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.rolling_icir(reports.paired_ic(exposures(spark, sf_dir), 10)), "icir")


def walk_forward_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.select_walk_forward(reports.paired_ic(exposures(spark, sf_dir), 10)), "mean_ic", "ir")


def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.quantile_returns(exposures(spark, sf_dir)), "mean_return")


def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.monotonicity(reports.quantile_returns(exposures(spark, sf_dir))), "monotonicity")


def top_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.top_turnover(exposures(spark, sf_dir)), "turnover")


def end_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.end_turnover(exposures(spark, sf_dir)), "turnover")


def spread_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.spread_stats(reports.spread_returns(exposures(spark, sf_dir), 8), 12), "sharpe", "volatility", "max_drawdown")


def factor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.factor_report(exposures(spark, sf_dir), 8, 12), "mean_ic", "ir", "icir", "win_rate", "sharpe", "volatility", "max_drawdown", "monotonicity", "turnover")


def factor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.factor_pairs(exposures(spark, sf_dir)), "rho", "rho_size")


def pooled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.pooled_pairs(exposures(spark, sf_dir)), "rho")


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.diversity(reports.factor_pairs(exposures(spark, sf_dir))), "diversity")


def overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(reports.overfitting(exposures(spark, sf_dir), "1996-01-01"), "overfitting", "decay")


def return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = panels.densify(panels.brand_panel(spark, sf_dir)).select("date", "instrument", F.coalesce(panels.padded_return(), F.lit(0.0)).alias("ret"))
    return _round(reports.mean_return_correlation(dense), "correlation")


def mad_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.mad_zscore(exposures(spark, sf_dir)).drop("target"), "value")


def tail_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.tail_zscore(exposures(spark, sf_dir)).drop("target"), "value")


def day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.by_day(exposures(spark, sf_dir)).drop("target"), "value")


def industry_size_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = panels.supplier_panel(spark, sf_dir).select(F.lit("close").alias("factor"), "date", "instrument", F.col("close").alias("value"), F.col("amount").alias("size")).join(panels.supplier_industry(spark, sf_dir), "instrument")
    return fusion.industry_size_residual(cells).select("date", "instrument", F.round("value", 4).alias("value"))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor, place, ic, icir, val_icir, n_periods, debate_score, tilt."""
    s = reports.ic_summary(reports.paired_ic(exposures(spark, sf_dir), 10))
    place = F.row_number().over(Window.orderBy("factor")) - 1
    return s.select("factor", place.alias("place"), F.col("mean_ic").alias("ic"), "icir", F.lit(None).cast("double").alias("val_icir"), F.col("days").alias("n_periods"), F.lit(0.0).alias("debate_score"), F.lit(0.0).alias("tilt"))


def icir_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.factor_weights(_table(spark, sf_dir), "icir_weighted"), "weight")


def shrunk_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.shrunk_weights(_table(spark, sf_dir)), "weight")


def penalised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.penalised(fusion.shrunk_weights(_table(spark, sf_dir)), reports.pooled_pairs(exposures(spark, sf_dir))), "weight")


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(fusion.composite(fusion.mad_zscore(exposures(spark, sf_dir)), fusion.factor_weights(_table(spark, sf_dir), "decay_weighted")), "score")


def weight_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(portfolio.turnover(_targets(spark, sf_dir)), "turnover")


def weights_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(portfolio.on_grid(_targets(spark, sf_dir), panels.densify(panels.brand_panel(spark, sf_dir)), "1995-01-01"), "weight")


def risk_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty suppliers of the largest volume a month, without small ones and those of one price, bounded by name and by region."""
    panel = panels.supplier_panel(spark, sf_dir)
    weights = portfolio.top_n(panel.select("date", "instrument", F.col("volume").alias("score")), 20, proportional=True)
    kept = portfolio.risk_managed(weights, panel.withColumnRenamed("amount", "cap"), panel.filter("high = low"), panels.supplier_industry(spark, sf_dir), 0.15, 0.01, 0.3, 0.1)
    return _round(kept, "weight")


def return_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = panels.densify(panels.brand_panel(spark, sf_dir))
    market = dense.select("date", F.coalesce(panels.padded_return(), F.lit(0.0)).alias("r")).groupBy("date").agg(F.avg("r").alias("market"))
    return portfolio.return_metrics(backtest(spark, sf_dir).join(market, "date"), 12)


QUERIES = {f.__name__: f for f in (ic_matrix, paired_ic, ic_summaries, masked_ic, rolling_icir, walk_forward_choice, quantile_returns, monotonicity, top_turnover, end_turnover, spread_stats, factor_report, factor_pairs, pooled_pairs, diversity, overfitting, return_correlation, mad_scores, tail_scores, day_scores, industry_size_residuals, icir_weights, shrunk_weights, penalised_weights, composite_scores, weight_turnover, weights_on_grid, risk_managed, return_metrics)}

_SUMMARY = f"""{_PAIRED.format(least=10)}, s AS (SELECT factor, count(*) AS days, avg(spearman) AS mean_ic, avg(spearman) / nullif(stddev_samp(spearman), 0) AS ir, CASE WHEN count(*) < 20 THEN 0 ELSE avg(spearman) / nullif(stddev_pop(spearman), 0) END AS icir, avg(CASE WHEN spearman > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ic WHERE spearman IS NOT NULL GROUP BY factor)"""
_SPREADS = f"""{_LONG}, ends AS (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, instrument) AS hi, row_number() OVER (PARTITION BY factor, date ORDER BY value, instrument) AS lo, count(*) OVER (PARTITION BY factor, date) AS m FROM known),
    sp AS (SELECT factor, date, avg(target) FILTER (hi <= 8) - avg(target) FILTER (lo <= 8) AS ret FROM ends WHERE m >= 16 GROUP BY factor, date),
    nav AS (SELECT *, product(1 + ret) OVER (PARTITION BY factor ORDER BY date) AS nav FROM sp), dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY factor ORDER BY date) - 1 AS down FROM nav)"""
_QUANTILE = f"""{_LONG}, {_BINS.format(t='known')}, daily AS (SELECT factor, date, bin, avg(target) AS r FROM bins GROUP BY ALL),
    q AS (SELECT f.factor, CAST(b.b AS INTEGER) AS bin, coalesce(avg(r), 0) AS mean_return FROM (SELECT DISTINCT factor FROM x) f CROSS JOIN range(5) b(b) LEFT JOIN daily ON daily.factor = f.factor AND daily.bin = b.b GROUP BY ALL)"""
_PAIRS = f"""{_LONG}, two AS (SELECT a.factor AS a, b.factor AS b, a.date, a.value AS x, b.value AS y FROM x a JOIN x b ON a.date = b.date AND a.instrument = b.instrument AND a.factor < b.factor WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
    rk AS (SELECT *, {_place('x', 'a, b, date')} AS rx, {_place('y', 'a, b, date')} AS ry FROM two), daily AS (SELECT a, b, date, {_CORR.format(a='rx', b='ry')} AS rho FROM rk GROUP BY a, b, date HAVING count(*) >= 3),
    pairs AS (SELECT a, b, count(*) AS days, avg(rho) AS rho, avg(abs(rho)) AS rho_size FROM daily WHERE rho IS NOT NULL GROUP BY a, b)"""
_DATES = "dates AS (SELECT factor, date, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM (SELECT DISTINCT factor, date FROM x))"
_DAY = "(PARTITION BY factor, date)"
ORACLE_SQL = {
    "ic_matrix": f"""{_LONG}, rk AS (SELECT factor, date, {_place('value')} AS f, {_place('target')} AS t FROM x), c AS (SELECT factor, date, f - avg(f) OVER {_DAY} AS f, t - avg(t) OVER {_DAY} AS t FROM rk)
        SELECT * FROM (SELECT factor, date, round(sum(f * t) / nullif(sqrt(sum(f * f)) * sqrt(sum(t * t)), 0), 6) AS ic FROM c GROUP BY factor, date) WHERE ic IS NOT NULL""",
    "paired_ic": f"{_PAIRED.format(least=10)} SELECT factor, date, n, round(spearman, 6) AS spearman, round(pearson, 6) AS pearson, round(spearman * (n - 1) / n, 6) AS sample_spearman FROM ic",
    "ic_summaries": f"{_SUMMARY} SELECT factor, days, round(mean_ic, 6) AS mean_ic, round(ir, 6) AS ir, round(icir, 6) AS icir, round(win_rate, 6) AS win_rate FROM s",
    "masked_ic": f"""{_LONG}, m AS (SELECT factor, date, CASE WHEN target IS NOT NULL THEN value END AS v, CASE WHEN value IS NOT NULL THEN target END AS t FROM x)
        SELECT factor, date, round(coalesce(covar_pop(v, t) / CASE WHEN stddev_pop(v) < 1e-3 OR stddev_pop(t) < 1e-3 THEN 1 ELSE stddev_pop(v) * stddev_pop(t) END, 0), 6) AS ic FROM m GROUP BY factor, date""",
    "rolling_icir": f"""{_PAIRED.format(least=10)} SELECT factor, date, round(CASE WHEN count(spearman) OVER w = 20 THEN avg(spearman) OVER w / (stddev_samp(spearman) OVER w + 1e-8) END, 6) AS icir FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "walk_forward_choice": f"""{_PAIRED.format(least=10)}, past AS (SELECT factor, date, avg(spearman) OVER w AS mean_ic, avg(spearman) OVER w / nullif(stddev_samp(spearman) OVER w, 0) AS ir FROM ic WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
        j AS (SELECT *, coalesce(abs(mean_ic) > 0.02 AND abs(ir) > 0.2, false) AS good, row_number() OVER (PARTITION BY date ORDER BY abs(mean_ic) DESC, factor) AS place FROM past WHERE mean_ic IS NOT NULL)
        SELECT factor, date, round(mean_ic, 6) AS mean_ic, round(ir, 6) AS ir FROM (SELECT *, bool_or(good) OVER (PARTITION BY date) AS found FROM j) WHERE good OR (NOT found AND place = 1)""",
    "quantile_returns": f"{_QUANTILE} SELECT factor, bin, round(mean_return, 6) AS mean_return FROM q",
    "monotonicity": f"""{_QUANTILE} SELECT factor, round(greatest(count(*) FILTER (step > 0), count(*) FILTER (step < 0)) / count(step), 6) AS monotonicity FROM (SELECT factor, mean_return - lag(mean_return) OVER (PARTITION BY factor ORDER BY bin) AS step FROM q) GROUP BY factor""",
    "top_turnover": f"""{_LONG}, {_DATES}, dated AS (SELECT * FROM x JOIN dates USING (factor, date)), pr AS (SELECT a.factor, a.date, a.instrument, a.value, b.value AS was FROM dated a JOIN dated b ON a.factor = b.factor AND a.instrument = b.instrument AND a.i = b.i + 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
        q AS (SELECT factor, date, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]))) AS e, list_sort(list_distinct(quantile_cont(was, [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]))) AS d FROM pr GROUP BY factor, date HAVING count(*) >= 10),
        t AS (SELECT factor, date, len(list_filter(e[2:-2], lambda v: v < value)) = 4 AS a, len(list_filter(d[2:-2], lambda v: v < was)) = 4 AS b FROM pr JOIN q USING (factor, date) WHERE len(e) > 1 AND len(d) > 1)
        SELECT factor, date, round(1 - count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS turnover FROM t GROUP BY factor, date HAVING count(*) FILTER (a OR b) > 0""",
    "end_turnover": f"""{_LONG}, {_DATES}, r AS (SELECT factor, date, instrument, i, ({_place('value')}) / count(value) OVER {_DAY} AS r FROM x JOIN dates USING (factor, date)), e AS (SELECT factor, date, instrument, i, r >= 0.8 AS hi, r <= 0.2 AS lo FROM r WHERE r >= 0.8 OR r <= 0.2),
        h AS (SELECT DISTINCT factor, i FROM e WHERE hi), l AS (SELECT a.factor, a.i + 1 AS i, count(*) FILTER (a.hi) AS nh, count(*) FILTER (a.lo) AS nl, count(*) FILTER (a.hi AND NOT coalesce(b.hi, false)) AS gh, count(*) FILTER (a.lo AND NOT coalesce(b.lo, false)) AS gl FROM e a LEFT JOIN e b ON a.factor = b.factor AND a.instrument = b.instrument AND b.i = a.i + 1 GROUP BY ALL)
        SELECT factor, date, round((gh / nh + coalesce(gl / nullif(nl, 0), 0)) / 2, 6) AS turnover FROM l JOIN h USING (factor, i) JOIN dates USING (factor, i) WHERE nh > 0""",
    "spread_stats": f"""{_SPREADS} SELECT factor, count(*) AS days, round(CASE WHEN count(*) < 20 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(12) END, 6) AS sharpe, round(CASE WHEN count(*) < 20 THEN 0 ELSE stddev_samp(ret) * sqrt(12) END, 6) AS volatility, round(CASE WHEN count(*) < 20 THEN 0 ELSE abs(min(down)) END, 6) AS max_drawdown FROM dd GROUP BY factor""",
    "factor_pairs": f"{_PAIRS} SELECT a, b, days, round(rho, 6) AS rho, round(rho_size, 6) AS rho_size FROM pairs",
    "pooled_pairs": f"""{_LONG}, r AS (SELECT factor, date, instrument, ({_place('value')}) / count(value) OVER {_DAY} AS r FROM x WHERE value IS NOT NULL)
        SELECT a.factor AS a, b.factor AS b, round(CASE WHEN count(*) >= 100 THEN coalesce(abs({_CORR.format(a='a.r', b='b.r')}), 0) ELSE 0 END, 6) AS rho FROM r a JOIN r b ON a.date = b.date AND a.instrument = b.instrument AND a.factor < b.factor GROUP BY a.factor, b.factor""",
    "diversity": f"{_PAIRS} SELECT factor, round(1 - max(rho_size), 6) AS diversity FROM (SELECT a AS factor, rho_size FROM pairs WHERE days >= 20 UNION ALL SELECT b, rho_size FROM pairs WHERE days >= 20) GROUP BY factor",
    "tail_scores": f"""{_LONG}, e AS (SELECT factor, date, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM x GROUP BY factor, date), c AS (SELECT factor, date, instrument, CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END AS c FROM x JOIN e USING (factor, date))
        SELECT factor, date, instrument, round((c - avg(c) OVER {_DAY}) / (stddev_samp(c) OVER {_DAY} + 1e-10), 6) AS value FROM c""",
    "mad_scores": f"""{_LONG}, m AS (SELECT factor, date, quantile_cont(value, 0.5) AS m FROM x GROUP BY factor, date), a AS (SELECT factor, date, m, quantile_cont(abs(value - m), 0.5) AS a FROM x JOIN m USING (factor, date) GROUP BY factor, date, m),
        c AS (SELECT factor, date, instrument, value, CASE WHEN value IS NULL OR NOT a > 0 THEN value ELSE greatest(m - 3 * 1.4826 * a, least(m + 3 * 1.4826 * a, value)) END AS c FROM x JOIN a USING (factor, date))
        SELECT factor, date, instrument, round(CASE WHEN c IS NULL THEN NULL WHEN count(c) OVER {_DAY} < 2 THEN value WHEN stddev_samp(c) OVER {_DAY} > 0 THEN (c - avg(c) OVER {_DAY}) / stddev_samp(c) OVER {_DAY} ELSE 0 END, 6) AS value FROM c""",
    "day_scores": f"{_LONG} SELECT factor, date, instrument, round(coalesce((value - avg(value) OVER {_DAY}) / nullif(stddev_pop(value) OVER {_DAY}, 0), 0), 6) AS value FROM x",
    "icir_weights": f"{_SUMMARY} SELECT factor, round(abs(icir) / sum(abs(icir)) OVER (), 6) AS weight, CASE WHEN abs(mean_ic) <= 1e-10 THEN 1.0 ELSE CAST(sign(mean_ic) AS DOUBLE) END AS sign FROM s",
}

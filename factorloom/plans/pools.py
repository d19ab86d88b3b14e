"""Queries of pool admission and of weights over each date's factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators import pool, reports
from factorloom.plans import reports as plans
from factorloom.plans.queries import _O, _panel
from factorloom.sources import panels

#: Lengths of the returns that are put up for admission, and the pool's threshold and capacity.
LAGS, THRESHOLD, CAPACITY = (1, 2, 3, 4, 5, 6, 8, 10, 12), 0.55, 4


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over several lengths and the volume of brands and months in long form, with the five-month return as target."""
    dense = panels.densify(panels.brand_panel(spark, sf_dir))
    back = lambda n: F.try_divide("close", F.lag("close", n).over(Window.partitionBy("instrument").orderBy("date"))) - 1
    wide = dense.select("date", "instrument", *[back(n).alias(f"r{n:02d}") for n in LAGS], F.col("volume").cast("double").alias("volume"), panels.forward_return(5).alias("target"))
    return wide.unpivot(["date", "instrument", "target"], [*[f"r{n:02d}" for n in LAGS], "volume"], "factor", "value").select("factor", "date", "instrument", "value", "target")


def pool_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors that a pool takes, in the order of their mean IC."""
    cells = returns(spark, sf_dir)
    singles = reports.ic_summary(reports.paired_ic(cells, 10)).select("factor", F.round("mean_ic", 9).alias("ic"))
    pairs = reports.factor_pairs(cells).select("a", "b", F.round("rho", 9).alias("rho"))
    return pool.admitted(singles, pairs, THRESHOLD, CAPACITY).select("factor", F.round("ic", 6).alias("ic"), "place")


def chosen_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward weights over the factors that are chosen for each date, one row for each."""
    cells = plans.exposures(spark, sf_dir)
    names = ["momentum", "reach", "volume"]
    wide = cells.groupBy("date", "instrument").pivot("factor", names).agg(F.first("value")).join(cells.filter("factor = 'reach'").select("date", "instrument", "target"), ["date", "instrument"])
    chosen = reports.select_walk_forward(reports.paired_ic(cells, 10))
    fitted = pool.chosen_weights(wide, names, chosen, embargo=5, window=36)
    return fitted.select("date", "n", F.posexplode_outer("names").alias("at", "factor"), "weights", "intercept").select("date", "n", "factor", F.round(F.get("weights", F.col("at")), 6).alias("weight"), F.round("intercept", 6).alias("intercept"))


QUERIES = {f.__name__: f for f in (pool_admission, chosen_weights)}

_NAMES = [*[f"r{n:02d}" for n in LAGS], "volume"]
_LONG = f"""{_panel('brand')}, wide AS (SELECT date, instrument, {', '.join(f'close / nullif(lag(close, {n}) OVER {_O}, 0) - 1 AS r{n:02d}' for n in LAGS)}, CAST(volume AS DOUBLE) AS volume, lead(close, 5) OVER {_O} / nullif(close, 0) - 1 AS target FROM g),
    x AS ({' UNION ALL '.join(f"SELECT '{n}' AS factor, date, instrument, {n} AS value, target FROM wide" for n in _NAMES)}),
    known AS (SELECT * FROM x WHERE value IS NOT NULL AND target IS NOT NULL)"""
_IC = plans._PAIRED.format(least=10).replace(plans._LONG, "")
_TWO = plans._PAIRS.replace(plans._LONG, "").replace("rk AS", "rk2 AS").replace("FROM rk GROUP", "FROM rk2 GROUP").replace("daily AS", "daily2 AS").replace("FROM daily WHERE", "FROM daily2 WHERE")
ORACLE_SQL: dict[str, str] = {
    "pool_admission": f"""{_LONG.replace('WITH lines', 'WITH RECURSIVE lines', 1)}{_IC}{_TWO},
    s AS (SELECT factor, coalesce(round(avg(spearman), 9), 0) AS ic FROM ic WHERE spearman IS NOT NULL GROUP BY factor),
    near AS (SELECT factor, list(other) AS others FROM (SELECT a AS factor, b AS other, rho FROM pairs UNION ALL SELECT b, a, rho FROM pairs) WHERE abs(round(rho, 9)) > {THRESHOLD} GROUP BY factor),
    ranked AS (SELECT s.factor, ic, coalesce(others, []) AS others, row_number() OVER (ORDER BY abs(ic) DESC, s.factor) AS k FROM s LEFT JOIN near ON near.factor = s.factor),
    greedy AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken
        UNION ALL SELECT r.k, CASE WHEN len(taken) < {CAPACITY} AND NOT list_has_any(taken, others) THEN list_append(taken, factor) ELSE taken END FROM greedy JOIN ranked r ON r.k = greedy.k + 1),
    done AS (SELECT taken FROM greedy ORDER BY k DESC LIMIT 1)
    SELECT factor, round(ic, 6) AS ic, CAST(list_position(taken, factor) AS INTEGER) AS place FROM ranked, done WHERE list_contains(taken, factor)""",
}

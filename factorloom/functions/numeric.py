"""Twins of the full-window dialect on calendar windows of n rows that pass over nulls: population moments, floored denominators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions import core, library
from factorloom.functions.core import Value, _pairwise, _row, col, delay, over
from factorloom.functions.expression import _mean_away

EPS = 1e-8


def warm(value: Column, n: int) -> Column:
    """Null before the instrument's n-th row."""
    return F.when(_row() >= n - 1, value)


def log(x: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(EPS))))


def div(x: Value, y: Value) -> Column:
    return F.when(F.abs(col(y)) < EPS, 0.0).otherwise(F.try_divide(col(x), col(y)))


def inv(x: Value) -> Column:
    return div(F.lit(1.0), x)


def power(x: Value, p: Value) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)) + EPS, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), col(p))))


def cs_rank(x: Value) -> Column:
    """Mean places of the date's known cells on 0 to 1; 0 where unknown or alone."""
    x = col(x)
    m = F.count(x).over(Window.partitionBy("date"))
    return F.when(x.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(core.rank(x) * m - 1, m - 1), F.lit(0.0)))


def greater(x: Value, y: Value) -> Column:
    return F.when(col(x) > col(y), 1.0).otherwise(0.0)


def less(x: Value, y: Value) -> Column:
    return F.when(col(x) < col(y), 1.0).otherwise(0.0)


def ts_mean(x: Value, n: int) -> Column:
    return warm(F.avg(col(x)).over(over(n)), n)


def ts_sum(x: Value, n: int) -> Column:
    return warm(F.coalesce(F.sum(col(x)).over(over(n)), F.lit(0.0)), n)


def ts_max(x: Value, n: int) -> Column:
    return warm(F.max(col(x)).over(over(n)), n)


def ts_min(x: Value, n: int) -> Column:
    return warm(F.min(col(x)).over(over(n)), n)


def ts_med(x: Value, n: int) -> Column:
    return warm(library.TS_MEDIAN(x, n), n)


def ts_mad(x: Value, n: int) -> Column:
    """Median distance from the median."""
    return warm(library.TS_MAD(x, n), n)


def ts_std(x: Value, n: int) -> Column:
    return warm(F.stddev_pop(col(x)).over(over(n)), n)


def ts_var(x: Value, n: int) -> Column:
    return warm(F.var_pop(col(x)).over(over(n)), n)


def ts_ir(x: Value, n: int) -> Column:
    return ts_mean(x, n) / F.greatest(ts_std(x, n), F.lit(EPS))


def _floored(x: Value, n: int) -> Column:
    back = delay(x, n)
    return F.when(back.isNotNull(), F.greatest(F.abs(back), F.lit(EPS)))


def ts_div(x: Value, n: int) -> Column:
    return col(x) / _floored(x, n)


def ts_pctchange(x: Value, n: int) -> Column:
    return (col(x) - delay(x, n)) / _floored(x, n)


def ts_rank(x: Value, n: int) -> Column:
    """The place on the date, once the instrument has n rows."""
    return warm(cs_rank(x), n)


def ts_wma(x: Value, n: int) -> Column:
    """Weights 1 to n over known cells' products."""
    x, i = col(x), _row()
    return warm((F.sum(x * i).over(over(n)) - (i - n) * F.sum(x).over(over(n))) / (n * (n + 1) / 2), n)


def ts_cov(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    return warm(F.covar_pop(a, b).over(over(n)), n)


def ts_corr(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    w = over(n)
    return warm(F.covar_pop(a, b).over(w) / (F.greatest(F.stddev_pop(a).over(w), F.lit(EPS)) * F.greatest(F.stddev_pop(b).over(w), F.lit(EPS))), n)


def mean_away(x: Value, n: int) -> Column:
    """Mean distance from the mean with at least half a window known."""
    return core.gated(_mean_away(x, n), col(x), n, max(2, n // 2))


def ts_ema(x: Value, n: int) -> Column:
    """From the n-th row on: the mean of what is known of the first n rows, then 2 / (n + 1) of each known cell and the rest of the last mean; a row without a cell repeats it, and where the first n rows know nothing the first cell begins."""
    x, i = col(x).cast("double"), _row()
    return core.ewm_recursive(F.when(i == n - 1, F.avg(x).over(over(n))).when(i >= n, x), 2 / (n + 1), weaken=False)

"""Formula functions of the full-window dialect: a window with fewer than n known cells gives null.

Spreads are sample ones unless said. `numeric` below holds the twins that floor
denominators, use population moments and need only full calendar windows.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions.core import Value, _pairwise, col, delay, over


def full(value: Column, x: Value, n: int) -> Column:
    return F.when(F.count(col(x)).over(over(n)) == n, value)


def cs_rank(x: Value) -> Column:
    """Places from 0 over the date's known cells, by their number; ties by instrument."""
    x = col(x)
    place = F.row_number().over(Window.partitionBy("date").orderBy(x.asc_nulls_last(), "instrument")) - 1
    return F.when(x.isNotNull(), place / F.count(x).over(Window.partitionBy("date")))


def inv(x: Value) -> Column:
    return F.try_divide(F.lit(1.0), col(x))


def s_log1p(x: Value) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def greater(x: Value, y: Value) -> Column:
    """The larger of two known cells."""
    return F.when(col(x).isNotNull() & col(y).isNotNull(), F.greatest(col(x), col(y)))


def less(x: Value, y: Value) -> Column:
    return F.when(col(x).isNotNull() & col(y).isNotNull(), F.least(col(x), col(y)))


def ref(x: Value, n: int) -> Column:
    """The cell n rows back; below 0, ahead, which only targets may use."""
    return F.lag(col(x), n).over(Window.partitionBy("instrument").orderBy("date"))


def ts_mean(x: Value, n: int) -> Column:
    return full(F.avg(col(x)).over(over(n)), x, n)


def ts_sum(x: Value, n: int) -> Column:
    return full(F.sum(col(x)).over(over(n)), x, n)


def ts_max(x: Value, n: int) -> Column:
    return full(F.max(col(x)).over(over(n)), x, n)


def ts_min(x: Value, n: int) -> Column:
    return full(F.min(col(x)).over(over(n)), x, n)


def ts_med(x: Value, n: int) -> Column:
    """The lower of the middle cells."""
    return full(F.get(F.array_sort(F.collect_list(col(x)).over(over(n))), F.lit((n - 1) // 2)), x, n)


def ts_std(x: Value, n: int) -> Column:
    return full(F.stddev_samp(col(x)).over(over(n)), x, n)


def ts_var(x: Value, n: int) -> Column:
    return full(F.var_samp(col(x)).over(over(n)), x, n)


def ts_ir(x: Value, n: int) -> Column:
    return F.try_divide(ts_mean(x, n), ts_std(x, n))


def ts_min_max_diff(x: Value, n: int) -> Column:
    return ts_max(x, n) - ts_min(x, n)


def ts_max_diff(x: Value, n: int) -> Column:
    return col(x) - ts_max(x, n)


def ts_min_diff(x: Value, n: int) -> Column:
    return col(x) - ts_min(x, n)


def ts_skew(x: Value, n: int) -> Column:
    return full(F.skewness(col(x)).over(over(n)), x, n)


def ts_kurt(x: Value, n: int) -> Column:
    """Fourth central moment over the squared sample variance, less 3."""
    whole = (F.kurtosis(col(x)).over(over(n)) + 3) * F.lit(((n - 1) / n) ** 2) - 3
    return full(whole, x, n)


def _mean_away(x: Value, n: int) -> Column:
    mean = F.avg(col(x)).over(over(n))
    cells = F.collect_list(col(x).cast("double")).over(over(n))
    return F.try_divide(F.aggregate(cells, F.lit(0.0), lambda s, v: s + F.abs(v - mean)), F.size(cells))


def ts_mad(x: Value, n: int) -> Column:
    """Mean distance from the mean."""
    return full(_mean_away(x, n), x, n)


def ts_rank(x: Value, n: int) -> Column:
    """Share of the window above the newest cell, ties at their mean place."""
    x = col(x)
    cells = F.collect_list(x).over(over(n))
    above, level = F.size(F.filter(cells, lambda v: v > x)), F.size(F.filter(cells, lambda v: v >= x))
    return full((above + level + F.when(level > above, 1).otherwise(0)) / (2 * n), x, n)


def ts_delta(x: Value, n: int) -> Column:
    return col(x) - delay(x, n)


def ts_div(x: Value, n: int) -> Column:
    return F.try_divide(col(x), delay(x, n))


def ts_pctchange(x: Value, n: int) -> Column:
    return ts_div(x, n) - 1


def _weighted(x: Value, weights: list[float]) -> Column:
    """Sum of a full window's cells by weights, oldest first."""
    n = len(weights)
    pairs = F.zip_with(F.collect_list(col(x).cast("double")).over(over(n)), F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)
    return full(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v), x, n)


def ts_wma(x: Value, n: int) -> Column:
    """Weights 0 to n - 1, the newest cell heaviest."""
    return _weighted(x, [2 * k / (n * (n - 1)) for k in range(n)])


def ts_ema(x: Value, n: int) -> Column:
    """Exponential weights within the window only."""
    powers = [(1 - 2 / (1 + n)) ** k for k in range(n, 0, -1)]
    return _weighted(x, [p / sum(powers) for p in powers])


def ts_cov(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    return full(F.covar_samp(a, b).over(over(n)), a, n)


def ts_corr(x: Value, y: Value, n: int) -> Column:
    """Sums of squares under 1e-6 leave the sum of products undivided."""
    a, b = _pairwise(x, y)
    w = over(n)
    left, right = F.var_pop(a).over(w) * n, F.var_pop(b).over(w) * n
    return full(F.covar_pop(a, b).over(w) * n / F.when((left < 1e-6) | (right < 1e-6), 1.0).otherwise(F.sqrt(left * right)), a, n)

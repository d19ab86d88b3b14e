"""Helpers of the one-ticker dialect: ranks and scales over an instrument's whole history, windows that begin with one known cell."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions import core
from factorloom.functions.core import Value, _pairwise, _row, col, over


def _history() -> Window:
    return Window.partitionBy("instrument")


def rank(x: Value) -> Column:
    """Mean places over the whole history, drawn to 0..1. It looks ahead."""
    x = col(x)
    below = F.rank().over(Window.partitionBy("instrument", x.isNull()).orderBy(x)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy("instrument", x))
    at_top = F.sum(F.when(x == F.max(x).over(_history()), 1).otherwise(0)).over(_history())
    return F.when(x.isNotNull(), F.try_divide(below + (ties - 1) / 2, F.count(x).over(_history()) - (at_top - 1) / 2 - 1))


def scale(x: Value) -> Column:
    """Standard score over the whole history, population deviation."""
    return F.try_divide(col(x) - F.avg(col(x)).over(_history()), F.stddev_pop(col(x)).over(_history()))


def ts_rank(x: Value, n: int) -> Column:
    """1 and the number of smaller cells in a full window."""
    x = col(x)
    cells = F.collect_list(x).over(over(n))
    return F.when(F.size(cells) == n, F.size(F.filter(cells, lambda v: v < x)) + 1.0)


def decay_linear(x: Value, n: int) -> Column:
    """Sum by weights k / n that is not normalised; a short window of L rows has weights k / L."""
    x, i = col(x), _row()
    length = F.least(i + 1, F.lit(n))
    return (F.sum(x * i).over(over(n)) - (i - length) * F.sum(x).over(over(n))) / length


def ts_sum(x: Value, n: int) -> Column:
    return F.sum(col(x)).over(over(n))


def ts_min(x: Value, n: int) -> Column:
    return F.min(col(x)).over(over(n))


def ts_max(x: Value, n: int) -> Column:
    return F.max(col(x)).over(over(n))


def sma(x: Value, n: int) -> Column:
    return F.avg(col(x)).over(over(n))


def stddev(x: Value, n: int) -> Column:
    return F.stddev_pop(col(x)).over(over(n))


def _from_start(at: Column, n: int) -> Column:
    return (at - F.greatest(_row() - n + 1, F.lit(0))).cast("double")


def ts_argmax(x: Value, n: int) -> Column:
    """Place of the oldest greatest cell from the window's start, from 0."""
    return _from_start(F.max_by(_row(), F.when(col(x).isNotNull(), F.struct(col(x), -_row()))).over(over(n)), n)


def ts_argmin(x: Value, n: int) -> Column:
    return _from_start(F.min_by(_row(), F.when(col(x).isNotNull(), F.struct(col(x), _row()))).over(over(n)), n)


def correlation(x: Value, y: Value, n: int) -> Column:
    """Null and undefined values as 0."""
    a, b = _pairwise(x, y)
    w = over(n)
    return F.coalesce(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), F.lit(0.0))


def covariance(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    return F.covar_samp(a, b).over(over(n))


def product(x: Value, n: int) -> Column:
    return F.product(col(x)).over(over(n))


def log(x: Value) -> Column:
    """0 at 0 and where unknown."""
    return F.coalesce(F.ln(F.nullif(col(x), F.lit(0.0))), F.lit(0.0))


def safe_denominator(x: Value) -> Column:
    """0 becomes 0.0001."""
    return F.when(col(x) == 0, 0.0001).otherwise(col(x))


def ema(x: Value, n: int) -> Column:
    """Exponential mean of span n without adjustment, from the first known cell on."""
    return core.ewm_recursive(x, 2 / (n + 1))


def atr(n: int = 14) -> Column:
    """Exponential mean of the largest of high - low, high - last close, low - last close, without absolute values; an unknown gap counts as 0, an unknown range as no cell."""
    return ema(widest(), n)


def widest() -> Column:
    """The range of atr()."""
    gap = lambda x: F.coalesce(F.col(x) - core.delay("close", 1), F.lit(0.0))
    span = F.col("high") - F.col("low")
    return F.when(span.isNotNull(), F.greatest(span, gap("high"), gap("low")))

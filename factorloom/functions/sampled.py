"""Formula functions of the sample-statistics dialect: at least max(2, n // 2) known cells, sample moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions import core, library
from factorloom.functions.core import Value, _pairwise, col, delay, gated, over
from factorloom.functions.numeric import mean_away

Ref, Delta, Mad = delay, core.ts_delta, mean_away


def _least(n: int) -> int:
    return max(2, n // 2)


def Mean(x: Value, n: int) -> Column:
    return gated(F.avg(col(x)).over(over(n)), col(x), n, _least(n))


def Sum(x: Value, n: int) -> Column:
    return gated(F.sum(col(x)).over(over(n)), col(x), n, _least(n))


def Min(x: Value, n: int) -> Column:
    return gated(F.min(col(x)).over(over(n)), col(x), n, _least(n))


def Max(x: Value, n: int) -> Column:
    return gated(F.max(col(x)).over(over(n)), col(x), n, _least(n))


def Std(x: Value, n: int) -> Column:
    return gated(F.stddev_samp(col(x)).over(over(n)), col(x), n, _least(n))


def Med(x: Value, n: int) -> Column:
    return gated(library.TS_MEDIAN(x, n), col(x), n, _least(n))


def Skew(x: Value, n: int) -> Column:
    return gated(core.ts_skew(x, n), col(x), n, _least(n))


def Kurt(x: Value, n: int) -> Column:
    return gated(core.ts_kurt(x, n), col(x), n, _least(n))


def Rank(x: Value, n: int | None = None) -> Column:
    """Share of the date's known cells up to x; n has no effect."""
    return core.rank(x)


def Corr(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    w = over(n)
    return gated(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), a, n, _least(n))


def Cov(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    return gated(F.covar_samp(a, b).over(over(n)), a, n, _least(n))


def Sigmoid(x: Value) -> Column:
    bound = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), col(x)))
    return F.when(col(x).isNotNull(), 1 / (1 + F.exp(-bound)))

"""Formula functions of the long-layout dialect: windows of present rows, one known cell is enough unless said."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from factorloom.functions import core
from factorloom.functions.core import Value, col, over


def TS_RANK(x: Value, n: int) -> Column:
    return core.pct_rank_in_window(x, n, 1)


def TS_MEDIAN(x: Value, n: int) -> Column:
    return F.percentile(col(x), F.lit(0.5)).over(over(n))


def TS_QUANTILE(x: Value, n: int, q: float) -> Column:
    return F.percentile(col(x), F.lit(q)).over(over(n))


def TS_STD(x: Value, n: int = 20) -> Column:
    return F.stddev_samp(x).over(over(n))


def TS_VAR(x: Value, n: int) -> Column:
    return F.var_samp(x).over(over(n))


def TS_ZSCORE(x: Value, n: int) -> Column:
    return F.try_divide(col(x) - F.avg(x).over(over(n)), F.stddev_samp(x).over(over(n)))


def ZSCORE(x: Value) -> Column:
    day = Window.partitionBy("date")
    return F.try_divide(col(x) - F.avg(x).over(day), F.stddev_samp(x).over(day))


def TS_MAD(x: Value, n: int) -> Column:
    """Median distance from the window's median."""
    middle = TS_MEDIAN(x, n)
    away = F.array_sort(F.transform(F.collect_list(x).over(over(n)), lambda v: F.abs(v - middle)))
    m = F.size(away)
    return (F.get(away, F.floor((m - 1) / 2).cast("int")) + F.get(away, F.floor(m / 2).cast("int"))) / 2


def _rows_back(x: Value, n: int, largest: bool) -> Column:
    """Rows back to the oldest greatest (least) cell of the window; a null counts as beyond all others, so the oldest null is taken where there is one. Null where no cell is known."""
    x, i = col(x), core._row()
    oldest_null = F.min(F.when(x.isNull(), i)).over(over(n))
    at = F.max_by(i, F.struct(x, -i)) if largest else F.min_by(i, F.struct(x, i))
    return F.when(F.count(x).over(over(n)) > 0, i - F.coalesce(oldest_null, at.over(over(n)))).cast("double")


def TS_ARGMAX(x: Value, n: int = 5) -> Column:
    """Rows back to the window's greatest cell; nulls as in HIGHDAY."""
    return _rows_back(x, n, True)


def TS_ARGMIN(x: Value, n: int = 5) -> Column:
    return _rows_back(x, n, False)


def HIGHDAY(x: Value, n: int) -> Column:
    """Rows back to the oldest greatest cell of the window, and 1; a null counts as beyond all others."""
    return _rows_back(x, n, True) + 1


def LOWDAY(x: Value, n: int) -> Column:
    """Rows back to the oldest least cell of the window, and 1; a null counts as beyond all others."""
    return _rows_back(x, n, False) + 1


def MAX(*values: Value) -> Column:
    """The greatest of the row's values; null if one is."""
    return _all_known(F.greatest(*map(col, values)), values)


def MIN(*values: Value) -> Column:
    return _all_known(F.least(*map(col, values)), values)


def _all_known(best: Column, values: tuple[Value, ...]) -> Column:
    known = F.lit(True)
    for v in values:
        known = known & col(v).isNotNull()
    return F.when(known, best)


def TS_COVARIANCE(x: Value, y: Value | list[float], n: int = 5) -> Column:
    """Sample covariance of two columns' pairs, two at least; or of a window with the first values of a fixed sequence, whose length is then the window."""
    if isinstance(y, list):
        n, pairs = len(y), _with_sequence(x, y)
        m = F.size(pairs)
        mean = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p[f]) / m
        product = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["v"] * p["w"])
        return F.when(m >= 2, (product - m * mean("v") * mean("w")) / (m - 1))
    a, b = core._pairwise(x, y)
    return core.gated(F.covar_samp(a, b).over(over(n)), a, n, 2)


def _with_sequence(x: Value, y: list[float]) -> Column:
    """The window's cells beside a fixed sequence's first values, oldest first."""
    cells = F.collect_list(F.struct(col(x).cast("double").alias("x"))).over(over(len(y)))
    return F.zip_with(cells, F.slice(F.array(*[F.lit(float(w)) for w in y]), F.lit(1), F.size(cells)), lambda c, w: F.struct(c["x"].alias("v"), w.alias("w")))


def TS_MAX(x: Value, n: int = 5) -> Column:
    return F.max(col(x)).over(over(n))


def TS_MIN(x: Value, n: int = 5) -> Column:
    return F.min(col(x)).over(over(n))


def TS_MEAN(x: Value, n: int = 5) -> Column:
    return F.avg(col(x)).over(over(n))


def TS_SUM(x: Value, n: int = 5) -> Column:
    return F.sum(col(x)).over(over(n))


def TS_CORR(x: Value, y: Value, n: int = 5) -> Column:
    a, b = core._pairwise(x, y)
    w = over(n)
    return core.gated(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), a, n, 2)


def TS_PCTCHANGE(x: Value, n: int) -> Column:
    return F.coalesce(core.ts_pct_change(x, n), F.lit(0.0))


def COUNT(condition: Column, n: int) -> Column:
    return F.sum(F.coalesce(condition.cast("double"), F.lit(0.0))).over(over(n))


def SUMIF(x: Value, n: int, condition: Column) -> Column:
    return F.sum(col(x) * condition.cast("double")).over(over(n))


def LOG(x: Value) -> Column:
    return F.log1p(x)


def EMA(x: Value, n: int) -> Column:
    """Exponential mean of span n with adjusted weights; null rows count as time."""
    return core.ewm_adjusted(x, 2 / (n + 1))


def MACD(x: Value, short: int = 12, long: int = 26) -> Column:
    return EMA(x, short) - EMA(x, long)


def BB_UPPER(x: Value, n: int) -> Column:
    return F.avg(x).over(over(n)) + TS_STD(x, n)


def BB_LOWER(x: Value, n: int) -> Column:
    return F.avg(x).over(over(n)) - TS_STD(x, n)


def _full(value: Column, n: int) -> Column:
    return F.when(core._row() >= n - 1, value)


def REGBETA(y: Value, x: Value, n: int) -> Column:
    """Slope of y on x over full windows."""
    a, b = F.coalesce(col(y), F.lit(0.0)), F.coalesce(col(x), F.lit(0.0))
    w = over(n)
    return _full(F.try_divide(F.covar_pop(a, b).over(w), F.var_pop(b).over(w)), n)


def REGRESI(y: Value, x: Value, n: int) -> Column:
    """What the slope leaves of the newest cell."""
    a, b = F.coalesce(col(y), F.lit(0.0)), F.coalesce(col(x), F.lit(0.0))
    w = over(n)
    return _full(a - F.avg(a).over(w) - REGBETA(y, x, n) * (b - F.avg(b).over(w)), n)


def collapsed(x: Value, how: str) -> Column:
    """MEAN, STD, SKEW, KURT or MEDIAN of the date's known cells, on each of its rows."""
    day = Window.partitionBy("date")
    x, m = col(x), F.count(col(x)).over(day)
    third = F.skewness(x).over(day) * F.try_divide(F.sqrt(m * (m - 1)), m - 2)
    fourth = F.try_divide(((m + 1) * F.kurtosis(x).over(day) + 6) * (m - 1), (m - 2) * (m - 3))
    return {"mean": F.avg(x).over(day), "std": F.stddev_samp(x).over(day), "skew": third, "kurt": fourth, "median": F.percentile(x, F.lit(0.5)).over(day)}[how]


def PERCENTILE(x: Value, q: float, n: int | None = None) -> Column:
    """Without a window, over the whole history, which looks ahead."""
    return F.percentile(col(x), F.lit(q)).over(over(n) if n else Window.partitionBy("instrument"))


def SUMAC(x: Value, n: int = 10) -> Column:
    return F.sum(col(x)).over(over(n))


def SMA(x: Value, m: int, n: float | None = None) -> Column:
    """The mean of m rows; with n, the exponential mean of weight n / m with adjusted weights."""
    return F.avg(col(x)).over(over(m)) if n is None else core.ewm_adjusted(x, n / m)


def _by_weights(x: Value, weights: list[float], total: bool) -> Column:
    """A window's cells by weights, oldest cell first; a short window takes the first weights. A null in the window gives null."""
    n = len(weights)
    cells = F.collect_list(F.struct(col(x).cast("double").alias("x"))).over(over(n))
    pairs = F.zip_with(cells, F.slice(F.array(*[F.lit(float(w)) for w in weights]), F.lit(1), F.size(cells)), lambda c, w: F.struct((c["x"] * w).alias("v"), w.alias("w")))
    add = lambda field: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p[field])
    return add("v") / add("w") if total else add("v")


def WMA(x: Value, n: int = 20) -> Column:
    """Weights 0.9 ** k, the newest of a full window heaviest."""
    return _by_weights(x, [0.9**k for k in range(n - 1, -1, -1)], True)


def DECAYLINEAR(x: Value, n: int = 5) -> Column:
    """Linear weights made to sum to 1 over a full window, also where the window is short."""
    return _by_weights(x, [2 * k / (n * (n + 1)) for k in range(1, n + 1)], False)


def PROD(x: Value, p: int | Value) -> Column:
    """The product of p rows, or with another column."""
    return F.product(col(x)).over(over(p)) if isinstance(p, int) else col(x) * col(p)


def FILTER(x: Value, condition: Column) -> Column:
    return col(x) * condition.cast("double")


def SEQUENCE(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: v.cast("double"))


def INV(x: Value) -> Column:
    return F.try_divide(F.lit(1.0), col(x))


def DIVIDE(x: Value, y: Value) -> Column:
    """Infinite with the sign of x where y is 0; null at 0 / 0."""
    x, y = col(x), col(y)
    return F.when((y == 0) & (x != 0), F.signum(x) * F.lit(float("inf"))).otherwise(F.try_divide(x, y))


def RSI(x: Value, n: int = 14) -> Column:
    """100 less 100 over 1 and the ratio of mean rises to mean falls; 100 where nothing fell."""
    up, down = (EMA(c, n) for c in moves(core.ts_delta(x, 1)))
    return strength(up, down)


def moves(change: Column) -> tuple[Column, Column]:
    """Rises and falls; null where the change is."""
    return F.when(change > 0, change).when(change.isNotNull(), 0.0), F.when(change < 0, -change).when(change.isNotNull(), 0.0)


def strength(up: Column, down: Column) -> Column:
    """RSI by the means of rises and falls."""
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))


def BB_MIDDLE(x: Value, n: int | Value) -> Column:
    """The mean of n rows; n may be a column, then of at most its row's number of newest cells."""
    if isinstance(n, int):
        return F.avg(col(x)).over(over(n))
    past = F.collect_list(col(x).cast("double")).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    m = F.least(F.size(past), col(n).cast("int"))
    return F.when(m > 0, F.aggregate(F.slice(past, F.size(past) - m + 1, m), F.lit(0.0), lambda s, v: s + v) / m)

"""Formula functions of the core dialect as columns over a dense panel (date, instrument).

A window is n rows of an instrument. Below its least number of known cells a
result is null. Functions nest: each takes and gives columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Value = Column | str


def col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over(n: int) -> Window:
    return Window.partitionBy("instrument").orderBy("date").rowsBetween(1 - n, 0)


def _row() -> Column:
    """The row's number in its instrument, from 0."""
    return F.row_number().over(Window.partitionBy("instrument").orderBy("date")) - 1


def gated(value: Column, x: Column, n: int, least: int) -> Column:
    return F.when(F.count(x).over(over(n)) >= least, value)


def _mean_gate(n: int) -> int:
    return max(1, n // 2)


def _pair_gate(n: int) -> int:
    return min(max(3, n // 2), n)


def _half_gate(n: int) -> int:
    return min(max(2, n // 2), n)


def _third_gate(n: int, least: int) -> int:
    return min(max(least, 2 * n // 3), n)


def rank(x: Value) -> Column:
    """Share of the date's known values up to x, ties at their mean."""
    x = col(x)
    place = F.rank().over(Window.partitionBy("date", x.isNull()).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", x))
    return F.when(x.isNotNull(), (place + (ties - 1) / 2) / F.count(x).over(Window.partitionBy("date")))


def scale(x: Value, a: float = 1.0) -> Column:
    x = col(x)
    return F.try_divide(x * a, F.sum(F.abs(x)).over(Window.partitionBy("date")))


def ts_mean(x: Value, n: int) -> Column:
    return gated(F.avg(x).over(over(n)), col(x), n, _mean_gate(n))


def ts_sum(x: Value, n: int) -> Column:
    return gated(F.sum(x).over(over(n)), col(x), n, _mean_gate(n))


def ts_min(x: Value, n: int) -> Column:
    return gated(F.min(x).over(over(n)), col(x), n, _mean_gate(n))


def ts_max(x: Value, n: int) -> Column:
    return gated(F.max(x).over(over(n)), col(x), n, _mean_gate(n))


def ts_std(x: Value, n: int) -> Column:
    return gated(F.stddev_pop(x).over(over(n)), col(x), n, _third_gate(n, 2))


def ts_var(x: Value, n: int) -> Column:
    return gated(F.var_pop(x).over(over(n)), col(x), n, _third_gate(n, 2))


def ts_skew(x: Value, n: int) -> Column:
    x, m = col(x), F.count(x).over(over(n))
    flat = F.min(x).over(over(n)) == F.max(x).over(over(n))
    return gated(F.when(flat, 0.0).otherwise(F.skewness(x).over(over(n)) * F.try_divide(F.sqrt(m * (m - 1)), m - 2)), x, n, _third_gate(n, 3))


def ts_kurt(x: Value, n: int) -> Column:
    x, m = col(x), F.count(x).over(over(n))
    flat = F.min(x).over(over(n)) == F.max(x).over(over(n))
    whole = F.try_divide(((m + 1) * F.kurtosis(x).over(over(n)) + 6) * (m - 1), (m - 2) * (m - 3))
    return gated(F.when(flat, -3.0).otherwise(whole), x, n, _third_gate(n, 4))


def ts_zscore(x: Value, n: int) -> Column:
    least = max(5, 2 * n // 3)
    if least > n:
        raise ValueError(f"a window of {n} is shorter than the {least} cells that it needs")
    x, dev = col(x), F.stddev_pop(x).over(over(n))
    return gated(F.when(x.isNull(), None).when(dev == 0, 0.0).otherwise(F.try_divide(x - F.avg(x).over(over(n)), dev)), x, n, least)


def _pairwise(x: Value, y: Value) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def ts_corr(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    w = over(n)
    return gated(F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)), a, n, _pair_gate(n))


def ts_cov(x: Value, y: Value, n: int) -> Column:
    a, b = _pairwise(x, y)
    return gated(F.covar_samp(a, b).over(over(n)), a, n, _pair_gate(n))


def delay(x: Value, n: int) -> Column:
    return F.lag(x, n).over(Window.partitionBy("instrument").orderBy("date"))


def ts_delta(x: Value, n: int) -> Column:
    return col(x) - delay(x, n)


def ts_pct_change(x: Value, n: int) -> Column:
    return F.try_divide(ts_delta(x, n), delay(x, n))


def _placed(x: Column, n: int) -> tuple[Column, Column]:
    """The window's known cells as (value, row) and the row that the window begins with."""
    return F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("x"), _row().alias("i")))).over(over(n)), F.greatest(_row() - n + 1, F.lit(0))


def ts_rank(x: Value, n: int) -> Column:
    """Percentile rank of the newest cell in its window, divided by n once more."""
    return pct_rank_in_window(x, n, _half_gate(n)) / n


def pct_rank_in_window(x: Value, n: int, least: int) -> Column:
    x = col(x)
    cells = F.collect_list(x).over(over(n))
    below = F.size(F.filter(cells, lambda v: v < x))
    same = F.size(F.filter(cells, lambda v: v == x))
    return gated(F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(cells)), x, n, least)


def ts_argmax(x: Value, n: int) -> Column:
    """n - 1 less the place of the oldest greatest cell in the window."""
    x, i = col(x), _row()
    at = F.max_by(i, F.when(x.isNotNull(), F.struct(x, -i))).over(over(n))
    return gated(((n - 1) - (at - F.greatest(i - n + 1, F.lit(0)))).cast("double"), x, n, _half_gate(n))


def ts_argmin(x: Value, n: int) -> Column:
    x, i = col(x), _row()
    at = F.min_by(i, F.when(x.isNotNull(), F.struct(x, i))).over(over(n))
    return gated(((n - 1) - (at - F.greatest(i - n + 1, F.lit(0)))).cast("double"), x, n, _half_gate(n))


def decay_linear(x: Value, n: int) -> Column:
    """Mean with weights up to n for the newest cell; nulls leave the weights' sum as it is."""
    x, i = col(x), _row()
    length = F.least(i + 1, F.lit(n))
    top = F.sum(x * i).over(over(n)) + (n - i) * F.sum(x).over(over(n))
    return gated(top / (length * n - length * (length - 1) / 2), x, n, _half_gate(n))


def ts_product(x: Value, n: int) -> Column:
    return gated(F.product(col(x)).over(over(n)), col(x), n, _half_gate(n))


def ts_slope(x: Value, n: int) -> Column:
    """Slope on 0..n-1, the sums of a full window standing for every window."""
    if n < 2:
        return F.lit(None).cast("double")
    x, i = col(x), _row()
    start = F.greatest(i - n + 1, F.lit(0))
    mean, spread = (n - 1) / 2, n * (n * n - 1) / 12
    total = F.sum(x).over(over(n))
    return gated((F.sum(x * i).over(over(n)) - start * total - mean * total) / spread, x, n, _third_gate(n, 3))


#: How far weights may fall within a block of rows; what lies before the block then counts for nothing in double precision.
_FALL = 200 * math.log(10)


def _last_known(y: Column) -> Column:
    return F.last(y, ignorenulls=True).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))


def ewm_adjusted(x: Value, alpha: float) -> Column:
    """Mean of all cells so far with weights (1 - alpha) ** rows back; null cells have no weight but count as rows. A row without a cell repeats the last mean."""
    x, keep = col(x).cast("double"), 1 - alpha
    if keep <= 0:
        return _last_known(x)
    size = max(int(-_FALL / math.log(keep)), 1)
    block = F.floor(_row() / size)
    inside = Window.partitionBy("instrument", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("instrument").orderBy(block).rangeBetween(-1, -1)
    grown = F.pow(F.lit(1 / keep), _row() - block * size)

    def total(v: Column) -> Column:
        own = F.coalesce(F.sum(v * grown).over(inside), F.lit(0.0)) / grown
        return own + F.coalesce(F.max_by(own, "date").over(before), F.lit(0.0)) * keep / grown

    return _last_known(F.try_divide(total(x), total(x.isNotNull().cast("double"))))


def ewm_recursive(x: Value, alpha: float, weaken: bool = True) -> Column:
    """(1 - alpha) of the last mean and alpha of the cell; g null rows between weaken the last mean's weight to (1 - alpha) ** (g + 1), the two weights then being made to sum to 1 (without `weaken` gaps change nothing). A row without a cell repeats the last mean."""
    x, keep = col(x).cast("double"), 1 - alpha
    if keep <= 0:
        return _last_known(x)
    known = F.when(x.isNotNull(), _row())
    last = F.max(known).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    old = F.pow(F.lit(keep), _row() - last if weaken else F.lit(1))
    share = F.when(x.isNull() | last.isNull(), 1.0).otherwise(F.greatest(old / (old + alpha), F.lit(1e-150)))
    added = F.when(x.isNotNull(), F.when(last.isNull(), x).otherwise((1 - share) * x))
    fall = -F.sum(F.ln(share)).over(Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    block = F.floor(fall / (_FALL / 4))  # what was known two blocks before has no weight left
    fallen, inside = F.product(share), Window.partitionBy("instrument", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.sum(added / fallen.over(inside)).over(inside), F.lit(0.0)) * fallen.over(inside)
    carried = F.max_by(own, "date").over(Window.partitionBy("instrument").orderBy(block).rangeBetween(Window.unboundedPreceding, -1))
    mean = own + F.coalesce(carried, F.lit(0.0)) * fallen.over(inside)
    return F.when(F.coalesce(last, known).isNotNull(), mean)


def with_ewm_adjusted(df: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """The table with columns of ewm_adjusted(column, alpha) by name, step by step, so that no window is made twice; means of similar alphas share one sort."""
    df = df if "_i" in df.columns else df.withColumn("_i", _row())
    sizes = {n: max(int(-_FALL / math.log(1 - a)), 1) for n, (_, a) in means.items() if a < 1}
    df = df.withColumns({n: _last_known(F.col(x)) for n, (x, a) in means.items() if a >= 1})
    while sizes:
        size = min(sizes.values())
        now = [n for n in sizes if sizes[n] <= 4 * size]  # their weights fall by a quarter of _FALL within a block at least
        sizes = {n: v for n, v in sizes.items() if n not in now}
        df = df.withColumn("_b", F.floor(F.col("_i") / size))
        inside = Window.partitionBy("instrument", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("instrument").orderBy("_b").rangeBetween(-1, -1)
        past = Window.partitionBy("instrument").orderBy("_b", "date").rowsBetween(Window.unboundedPreceding, 0)
        keep = {n: 1 - means[n][1] for n in now}
        grown = {n: F.pow(F.lit(1 / keep[n]), F.col("_i") - F.col("_b") * size) for n in now}
        cells = {f"_{k}_{n}": (n, x) for n in now for k, x in (("v", F.col(means[n][0]).cast("double")), ("w", F.col(means[n][0]).isNotNull().cast("double")))}
        df = df.withColumns({c: x * grown[n] for c, (n, x) in cells.items()}).withColumns({c: F.sum(c).over(inside) for c in cells})
        df = df.withColumns({c: F.coalesce(c, F.lit(0.0)) / grown[n] for c, (n, _) in cells.items()}).withColumns({f"{c}_old": F.max_by(c, "date").over(before) for c in cells})
        total = lambda c, n: F.col(c) + F.coalesce(f"{c}_old", F.lit(0.0)) * keep[n] / grown[n]
        df = df.withColumns({n: F.try_divide(total(f"_v_{n}", n), total(f"_w_{n}", n)) for n in now}).drop(*cells, *[f"{c}_old" for c in cells])
        df = df.withColumns({n: F.last(n, ignorenulls=True).over(past) for n in now}).drop("_b")
    return df


def with_ewm_recursive(df: DataFrame, name: str, x: str, alpha: float, weaken: bool = True) -> DataFrame:
    """The table with the column ewm_recursive(x, alpha), step by step, so that no window is made twice."""
    df = df if "_i" in df.columns else df.withColumn("_i", _row())
    keep, cell = 1 - alpha, F.col(x).cast("double")
    if keep <= 0:
        return df.withColumn(name, _last_known(cell))
    by_date = Window.partitionBy("instrument").orderBy("date")
    known = F.when(cell.isNotNull(), F.col("_i"))
    df = df.withColumn("_last", F.max(known).over(by_date.rowsBetween(Window.unboundedPreceding, -1)))
    old = F.pow(F.lit(keep), F.col("_i") - F.col("_last") if weaken else F.lit(1))
    df = df.withColumn("_share", F.when(cell.isNull() | F.col("_last").isNull(), 1.0).otherwise(F.greatest(old / (old + alpha), F.lit(1e-150))))
    df = df.withColumn("_added", F.when(cell.isNotNull(), F.when(F.col("_last").isNull(), cell).otherwise((1 - F.col("_share")) * cell)))
    df = df.withColumn("_fall", -F.sum(F.ln("_share")).over(by_date.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.floor(F.col("_fall") / (_FALL / 4)))
    inside = Window.partitionBy("instrument", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_fallen", F.product("_share").over(inside)).withColumn("_part", F.col("_added") / F.col("_fallen"))
    df = df.withColumn("_own", F.sum("_part").over(inside)).withColumn("_own", F.coalesce("_own", F.lit(0.0)) * F.col("_fallen"))
    df = df.withColumn("_carried", F.max_by("_own", "date").over(Window.partitionBy("instrument").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)))
    mean = F.col("_own") + F.coalesce("_carried", F.lit(0.0)) * F.col("_fallen")
    return df.withColumn(name, F.when(F.coalesce("_last", known).isNotNull(), mean)).drop("_last", "_share", "_added", "_fall", "_b", "_fallen", "_part", "_own", "_carried")


def ts_decay(x: Value, n: int) -> Column:
    """Exponential mean of span n without adjustment; a gap weakens what came before it."""
    past = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(col(x)).over(past) >= max(3, n // 2), ewm_recursive(x, 2 / (n + 1)))


def sign(x: Value) -> Column:
    return F.signum(x)


def log(x: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(1e-10))))


def sqrt(x: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def signedpower(x: Value, p: float = 2) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def if_(condition: Value, a: Value, b: Value) -> Column:
    """a where the condition is not 0, null included; else b."""
    c = col(condition)
    return F.when(c.isNull() | (c != 0), col(a)).otherwise(col(b))


def ele_min(x: Value, y: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(x, col(y)))


def ele_max(x: Value, y: Value) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, col(y)))


def greater(x: Value, y: Value) -> Column:
    """1 where x > y, else 0, nulls included."""
    return F.when(col(x) > col(y), 1.0).otherwise(0.0)

"""Technical features, targets and sequences for models over a dense panel, and a boosted model of them."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import core
from factorloom.sources import panels


def _rolled(f, x: Column | str, n: int, least: int) -> Column:
    return core.gated(f(x).over(core.over(n)), core.col(x), n, least)


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def raw_features(panel: DataFrame) -> DataFrame:
    """date, instrument and the technical features of a dense panel with open to amount (pe, pb, roe, market_cap where it has them), before they are made comparable."""
    close, volume = F.col("close"), F.col("volume")
    base = panel.withColumns({"_ret": panels.padded_return(), "_change": close - core.delay("close", 1), "_vwap": F.col("amount") / (volume + 1e-10)})
    mean = lambda x, n: _rolled(F.avg, x, n, {5: 3, 10: 5, 14: 7, 20: 10}[n])
    gain, loss = F.greatest(F.col("_change"), F.lit(0.0)), F.greatest(-F.col("_change"), F.lit(0.0))
    known = base.withColumns({"_gain": F.when(F.col("_change").isNotNull(), gain), "_loss": F.when(F.col("_change").isNotNull(), loss)})
    ma = {n: mean("close", n) for n in (5, 10, 20)}
    high, low = _rolled(F.max, "high", 20, 10), _rolled(F.min, "low", 20, 10)
    above = lambda x: F.when(close > x, 1.0).otherwise(0.0)
    features = {
        **{f"ret_{n}d": panels.padded_return(n) for n in (1, 5, 10, 20)},
        **{f"vol_{n}d": _rolled(F.stddev_samp, "_ret", n, max(3, n // 2)) for n in (5, 10, 20)},
        "turnover_5d": F.try_divide(volume, mean("volume", 5)), "turnover_20d": F.try_divide(volume, mean("volume", 20)), "volume_ratio_5_20": F.try_divide(mean("volume", 5), mean("volume", 20)),
        "rsi_14": 100 - 100 / (1 + mean("_gain", 14) / (mean("_loss", 14) + 1e-10)),
        **{f"ma_{n}": ma[n] for n in (5, 10, 20)}, "ma_diff_5_20": (ma[5] - ma[20]) / (ma[20] + 1e-10), "price_above_ma5": above(ma[5]), "price_above_ma20": above(ma[20]),
        "high_low_range_10d": (high - low) / (low + 1e-10), "close_to_high_20d": (high - close) / (high - low + 1e-10), "close_to_low_20d": (close - low) / (high - low + 1e-10),
        "vwap_dev_5d": _finite((close - mean("_vwap", 5)) / (mean("_vwap", 5) + 1e-10)),
        **{c: F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col(c))) if c in ("pe", "pb") else F.col(c) for c in ("pe", "pb", "roe", "market_cap") if c in panel.columns},
    }
    return known.select("date", "instrument", *[c.alias(n) for n, c in features.items()])


def comparable(features: DataFrame) -> DataFrame:
    """Each feature cut at 3 * 1.4826 median distances from its date's median, then as standard scores of the date (1e-10 added to the deviation)."""
    names = [c for c in features.columns if c not in ("date", "instrument")]
    day = Window.partitionBy("date")
    median = lambda c: F.percentile(c, F.lit(0.5)).over(day)
    middle = features.repartition("date").select("*", *[median(F.col(c)).alias(f"_m_{c}") for c in names])
    away = middle.select("*", *[(median(F.abs(F.col(c) - F.col(f"_m_{c}"))) * 3 * 1.4826).alias(f"_w_{c}") for c in names])
    m, w = lambda c: F.col(f"_m_{c}"), lambda c: F.col(f"_w_{c}")
    cut = away.select("date", "instrument", *[F.when(F.col(c).isNotNull(), F.greatest(m(c) - w(c), F.least(m(c) + w(c), F.col(c)))).alias(c) for c in names])
    return cut.select("date", "instrument", *[((F.col(c) - F.avg(c).over(day)) / (F.stddev_samp(c).over(day) + 1e-10)).alias(c) for c in names])


def technical_features(panel: DataFrame) -> DataFrame:
    return comparable(raw_features(panel))


def rank_target(panel: DataFrame, horizon: int = 10) -> DataFrame:
    """date, instrument, target_rank: the share of the date's forward returns up to the own."""
    ahead = panel.select("date", "instrument", panels.forward_return(horizon).alias("_f"))
    return ahead.select("date", "instrument", core.rank("_f").alias("target_rank"))


def clipped_target(panel: DataFrame, horizon: int = 10, k: float = 3.0) -> DataFrame:
    """date, instrument, forward_return: cut at k sample deviations from the date's mean."""
    ahead = panel.select("date", "instrument", panels.forward_return(horizon).alias("_f"))
    day = Window.partitionBy("date")
    mean, dev = F.avg("_f").over(day), F.stddev_samp("_f").over(day)
    cut = F.when(dev.isNull(), F.col("_f")).otherwise(F.least(F.greatest(F.col("_f"), mean - k * dev), mean + k * dev))
    return ahead.select("date", "instrument", F.when(F.col("_f").isNotNull(), cut).alias("forward_return"))


def daily_return(panel: DataFrame) -> DataFrame:
    return panel.select("date", "instrument", panels.padded_return().alias("daily_return"))


def sequences(features: DataFrame, names: list[str], n: int = 20) -> DataFrame:
    """date, instrument, sequence: the last n rows of an instrument, oldest first, each an array of the features filled forward, then with 0; only where there are n rows."""
    filled = features.select("date", "instrument", F.array(*[F.coalesce(panels.forward_fill(c), F.lit(0.0)) for c in names]).alias("_x"))
    rows = F.collect_list("_x").over(core.over(n))
    return filled.select("date", "instrument", rows.alias("sequence")).filter(F.size("sequence") == n)


def boosted_scores(train: DataFrame, test: DataFrame, names: list[str], target: str, trees: int = 20, depth: int = 5, step: float = 0.05, seed: int = 42) -> DataFrame:
    """date, instrument, score of the test rows by boosted regression trees fitted to the training rows that have a target; unknown features count as 0, their mean."""
    known = lambda rows: VectorAssembler(inputCols=names, outputCol="_v").transform(rows.na.fill(0.0, names))
    model = GBTRegressor(featuresCol="_v", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed, predictionCol="score")
    return model.fit(known(train.filter(F.col(target).isNotNull()))).transform(known(test)).select("date", "instrument", "score")


def default_factors(panel: DataFrame) -> DataFrame:
    """date, instrument and the six factors that stand in where none were made; windows are full."""
    base = panel.select("*", F.coalesce(panels.padded_return(), F.lit(0.0)).alias("_r"))
    full = lambda f, x, n: core.gated(f(x).over(core.over(n)), core.col(x), n, n)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return base.select(
        "date", "instrument", full(F.sum, "_r", 20).alias("momentum_20d"), (-full(F.sum, "_r", 5)).alias("mean_reversion_5d"), (-full(F.stddev_samp, "_r", 20)).alias("volatility_20d"),
        zero(F.try_divide("volume", full(F.avg, "volume", 20)) - 1).alias("volume_zscore"), full(F.sum, "_r", 5).alias("momentum_5d"), zero(F.try_divide("close", full(F.min, "close", 10)) - 1).alias("high_low_spread"),
    )

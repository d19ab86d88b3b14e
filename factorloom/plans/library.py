"""Queries of formula libraries, factor selection, memory, features and learned weights, with DuckDB SQL where the same rows can be said in it."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import alphas, formulas, library, scalar
from factorloom.operators import features, fusion, learned, memory, portfolio, reports, selection
from factorloom.plans.queries import _O, REGIMES, _columns, _panel, _w
from factorloom.plans.reports import _LONG, exposures
from factorloom.sources import files, panels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.densify(panels.brand_panel(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f):
    QUERIES[f.__name__] = f
    return f


def alpha_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir)
    return dense.select("*", panels.padded_return().alias("returns"), F.try_divide("amount", "volume").alias("vwap"))


@query
def alpha_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formulas of the library over brands and months, in one plan."""
    return _rounded(formulas.exposures(alpha_panel(spark, sf_dir), alphas.PANEL_ALPHAS, alphas.PANEL_DIALECT))


@query
def seed_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(formulas.seeds(_dense(spark, sf_dir)))


class _Sql(str):
    """SQL of a cell, which arithmetic joins as Sheet's cells are joined."""

    def __add__(self, o): return _Sql(f"({self} + {o})")
    def __radd__(self, o): return _Sql(f"({o} + {self})")
    def __sub__(self, o): return _Sql(f"({self} - {o})")
    def __rsub__(self, o): return _Sql(f"({o} - {self})")
    def __mul__(self, o): return _Sql(f"({self} * {o})")
    def __rmul__(self, o): return _Sql(f"({o} * {self})")
    def __truediv__(self, o): return _Sql(f"({self} / nullif({o}, 0))")
    def __rtruediv__(self, o): return _Sql(f"({o} / nullif({self}, 0))")


#: Seeds whose windows are over the panel's own columns.
_FLAT = [k for k in formulas.SEEDS if k not in ("RSIMomentum", "RSI_manual", "ATRMomentum", "Price_vs_SMA14_delay7", "EMA20_minus_Close", "InverseRSI", "ATR", "HL_EMA_ratio", "ExponentialMovingAverage")]


@query
def seed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds without recursion or nested windows."""
    return _rounded(formulas.seeds(_dense(spark, sf_dir), {k: formulas.SEEDS[k] for k in _FLAT}))


def _seed_sql() -> str:
    over = lambda name: lambda x, n: _Sql(f"{name}({x}) OVER {_w(n)}")
    names = {f: _Sql(f"CAST({f} AS DOUBLE)") for f in ("high", "low", "close", "volume")}
    names |= {"delay": lambda x, n: _Sql(f"lag({x}, {n}) OVER {_O}"), "sma": over("avg"), "lowest": over("min"), "highest": over("max"), "std": over("stddev_samp")}
    cells = [f"round({formulas.SEEDS[k](SimpleNamespace(**names))}, 6) AS {k}" for k in _FLAT]
    return f"{_panel('brand')} SELECT date, instrument, {', '.join(cells)} FROM g"


ORACLE_SQL["seed_windows"] = _seed_sql()


def _scalars() -> None:
    x, y = "(close / 1000 - 15)", "(open / 1000 - 15)"
    sx, sy = lambda: F.col("close") / 1000 - 15, lambda: F.col("open") / 1000 - 15
    safe = lambda sql, x, low, other: f"CASE WHEN abs({x}) > {low} THEN {sql} WHEN {x} IS NOT NULL THEN {other} END"
    _columns("scalar_protected", {
        "div": (lambda: scalar.div(sx(), sy()), safe(f"{x} / nullif({y}, 0)", y, 0.001, 1.0)), "sqrt": (lambda: scalar.sqrt(sx()), f"sqrt(abs({x}))"), "log": (lambda: scalar.log(sx()), safe(f"ln(abs({x}))", x, 0.001, 0.0)),
        "inv": (lambda: scalar.inv(sx()), safe(f"1 / {x}", x, 0.001, 0.0)), "sig": (lambda: scalar.sig(sx()), f"1 / (1 + exp(-{x}))"), "n4": (lambda: scalar.GUARDED["n4"](sx()), f"CASE WHEN abs({x}) < 1e6 THEN pow({x}, 4) WHEN {x} IS NOT NULL THEN 0 END"),
        "expneg": (lambda: scalar.GUARDED["expneg"](sx() / 4), f"CASE WHEN {x} / 4 > -100 THEN exp(-{x} / 4) WHEN {x} IS NOT NULL THEN 0 END"), "tanh": (lambda: scalar.PLAIN["tanh"](sx()), f"(exp({x}) - exp(-{x})) / (exp({x}) + exp(-{x}))"),
        "wrapped": (lambda: scalar.WRAPS["log"](sx()), f"ln(abs({x}) + 1e-8)"), "joined": (lambda: scalar.JOINS["div"](sx(), F.abs(sy())), f"{x} / (abs({y}) + 1e-8)"),
    }, "brand", (QUERIES, ORACLE_SQL))
    w5, i = _w(5), "i"
    null5 = f"min(CASE WHEN close IS NULL THEN {i} END) OVER {w5}"
    back = lambda f, s: f"CASE WHEN count(close) OVER {w5} > 0 THEN {i} - coalesce({null5}, {f}(i, CASE WHEN close IS NOT NULL THEN row(close, {s}i) END) OVER {w5}) END"
    _columns("d2_more_windows", {
        "argmax": (lambda: library.TS_ARGMAX("close", 5), back("arg_max", "-")), "argmin": (lambda: library.TS_ARGMIN("close", 5), back("arg_min", "")), "highday": (lambda: library.HIGHDAY("close", 5), f"1 + {back('arg_max', '-')}"), "lowday": (lambda: library.LOWDAY("close", 5), f"1 + {back('arg_min', '')}"),
        "greatest": (lambda: library.MAX("open", "close", F.lag("close", 1).over(panels.by_instrument())), f"CASE WHEN open IS NOT NULL AND close IS NOT NULL AND lag(close) OVER {_O} IS NOT NULL THEN greatest(open, close, lag(close) OVER {_O}) END"),
        "least": (lambda: library.MIN("open", "close"), "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END"),
        "cov": (lambda: library.TS_COVARIANCE("close", "volume", 5), f"CASE WHEN count(CASE WHEN volume IS NOT NULL THEN close END) OVER {w5} >= 2 THEN covar_samp(close, volume) OVER {w5} END"),
        "corr": (lambda: library.TS_CORR("close", "volume", 5), f"CASE WHEN count(CASE WHEN volume IS NOT NULL THEN close END) OVER {w5} >= 2 THEN covar_pop(close, volume) OVER {w5} / nullif(stddev_pop(CASE WHEN volume IS NOT NULL THEN close END) OVER {w5} * stddev_pop(CASE WHEN close IS NOT NULL THEN volume END) OVER {w5}, 0) END"),
        "most": (lambda: library.TS_MAX("high", 5), f"max(high) OVER {w5}"), "lowest": (lambda: library.TS_MIN("low", 5), f"min(low) OVER {w5}"), "mean": (lambda: library.TS_MEAN("close", 5), f"avg(close) OVER {w5}"), "total": (lambda: library.TS_SUM("volume", 5), f"sum(volume) OVER {w5}"),
        "zscore": (lambda: library.ZSCORE("close"), "(close - avg(close) OVER (PARTITION BY date)) / nullif(stddev_samp(close) OVER (PARTITION BY date), 0)"),
        "divide": (lambda: library.DIVIDE(F.col("close"), F.col("volume")), "close / nullif(volume, 0)"),
    }, "supplier", (QUERIES, ORACLE_SQL))
    # Weights of a window by rows back; a null has none, and a row without a cell repeats what the last one had.
    q = 1 - 2 / 6
    past = "(PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ewm = lambda keep: f"sum(close * pow({1 / keep}, i)) OVER {past} / nullif(sum(CASE WHEN close IS NOT NULL THEN pow({1 / keep}, i) END) OVER {past}, 0)"
    _columns("d2_exponential", {
        "ema": (lambda: library.EMA("close", 5), ewm(q)), "sma": (lambda: library.SMA("close", 6, 2.0), ewm(1 - 2.0 / 6)), "macd": (lambda: library.MACD("close", 3, 8), f"{ewm(0.5)} - {ewm(1 - 2 / 9)}"),
    }, "supplier", (QUERIES, ORACLE_SQL))


_scalars()


# --- market state and memory -------------------------------------------------


@query
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four regimes of the mean close of brands; the interest rate and the correlation of returns are made from the mean volume and the row's number."""
    proxy = _dense(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("close"), F.avg("volume").alias("v"))
    return memory.market_state(proxy.select("date", "close", (F.pmod(F.floor("v"), F.lit(50)) / 10).alias("rate"), (F.month("date") / 12).alias("matching")))


ORACLE_SQL["market_regimes"] = f"{_panel('brand')}, m AS (SELECT date, avg(close) AS close, (CAST(floor(avg(volume)) AS BIGINT) % 50) / 10.0 AS rate, month(date) / 12.0 AS matching FROM g GROUP BY date HAVING avg(close) IS NOT NULL), {REGIMES}"


def _state(of: str):
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), F.expr(f"cast({of} % {k} as int)"))
    return F.struct(pick(("low", "medium", "high"), 3).alias("volatility"), pick(("abundant", "normal"), 2).alias("liquidity"), pick(("bull", "bear", "sideways"), 3).alias("trend"), pick(("low", "high"), 2).alias("correlation"))


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory whose figures follow from the vectors' ids."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(
        F.col("vec_id").cast("string").alias("factor_id"), "vec_id", "embedding", _state("vec_id").alias("market_state"), ((F.col("vec_id") * 37 % 101) / 1000 - 0.03).alias("ic"), ((F.col("vec_id") * 17 % 23) / 10).alias("icir"), ((F.col("vec_id") * 13 % 47) / 10 - 1).alias("sharpe"),
        ((F.col("vec_id") * 7 % 11) / 10).alias("win_rate"), (-(F.col("vec_id") % 9) / 20).alias("max_drawdown"), ((F.col("vec_id") * 53 % 89) / 1000 - 0.02).alias("val_ic"), (F.col("vec_id") % 4 == 0).alias("has_val"), (F.col("vec_id") % 6).cast("int").alias("retrieval_count"),
    )


@query
def memory_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 the five stored ones of the best score by likeness, state and quality."""
    held = _memory(spark, sf_dir)
    asked = held.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("market_state").alias("now"))
    return memory.retrieve(held, asked).select("query_id", "factor_id", F.round("score", 6).alias("score"), "place")


@query
def memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _memory(spark, sf_dir).drop("embedding", "market_state", "vec_id")
    new = held.filter("cast(factor_id as long) % 3 = 0").select(F.when(F.col("factor_id").cast("long") % 2 == 0, F.col("factor_id")).otherwise(F.concat(F.lit("n"), "factor_id")).alias("factor_id"), *[(F.col(c) * 2 + 0.01).alias(c) for c in ("ic", "icir", "sharpe", "win_rate", "max_drawdown", "val_ic")], "has_val", F.lit(0).alias("retrieval_count"))
    return _rounded(memory.upsert(held, new))


_MEMORY = """m AS (SELECT CAST(vec_id AS VARCHAR) AS factor_id, vec_id, CAST(embedding AS DOUBLE[]) AS e, (vec_id * 37 % 101) / 1000.0 - 0.03 AS ic, (vec_id * 17 % 23) / 10.0 AS icir, (vec_id * 13 % 47) / 10.0 - 1 AS sharpe, (vec_id * 7 % 11) / 10.0 AS win_rate,
    -(vec_id % 9) / 20.0 AS max_drawdown, (vec_id * 53 % 89) / 1000.0 - 0.02 AS val_ic, vec_id % 4 = 0 AS has_val, CAST(vec_id % 6 AS INTEGER) AS retrieval_count FROM embeddings)"""
ORACLE_SQL["memory_retrieve"] = f"""WITH {_MEMORY}, q AS (SELECT * FROM m WHERE vec_id % 100 = 0), p AS (SELECT * FROM m WHERE CASE WHEN has_val THEN val_ic ELSE ic END >= 0.02),
    s AS (SELECT q.vec_id AS query_id, p.factor_id, round((0.7 * list_cosine_similarity(p.e, q.e) + 0.3 * (2 * CAST(p.vec_id % 3 = q.vec_id % 3 AS INTEGER) + 2 * CAST(p.vec_id % 2 = q.vec_id % 2 AS INTEGER)) / 4.0)
        * least(0.5 * abs(p.ic) + 0.3 * greatest(p.sharpe, 0) / 3 + 0.2 * p.win_rate + 0.05 * ln(1 + p.retrieval_count), 1), 9) AS score FROM p CROSS JOIN q)
    SELECT query_id, factor_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, factor_id) AS INTEGER) AS place FROM s QUALIFY place <= 5"""
_FIGURES = ("ic", "icir", "sharpe", "win_rate", "max_drawdown")
ORACLE_SQL["memory_upsert"] = f"""WITH {_MEMORY}, n AS (SELECT CASE WHEN vec_id % 2 = 0 THEN factor_id ELSE 'n' || factor_id END AS factor_id, {', '.join(f'{c} * 2 + 0.01 AS {c}' for c in (*_FIGURES, 'val_ic'))}, has_val, 0 AS retrieval_count FROM m WHERE vec_id % 3 = 0)
    SELECT coalesce(m.factor_id, n.factor_id) AS factor_id, {', '.join(f'round(CASE WHEN m.factor_id IS NULL THEN n.{c} WHEN n.factor_id IS NULL THEN m.{c} ELSE 0.7 * m.{c} + 0.3 * n.{c} END, 6) AS {c}' for c in _FIGURES)},
        round(CASE WHEN m.factor_id IS NULL THEN n.val_ic WHEN n.factor_id IS NULL OR NOT n.has_val THEN m.val_ic ELSE 0.7 * m.val_ic + 0.3 * n.val_ic END, 6) AS val_ic, coalesce(m.has_val, false) OR coalesce(n.has_val, false) AS has_val,
        coalesce(m.retrieval_count, n.retrieval_count) AS retrieval_count FROM m FULL JOIN n ON m.factor_id = n.factor_id"""


# --- features and targets ----------------------------------------------------


@query
def technical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.technical_features(_dense(spark, sf_dir)))


@query
def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.raw_features(_dense(spark, sf_dir)))


@query
def model_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir)
    return _rounded(features.rank_target(dense, 5).join(features.clipped_target(dense, 5, 1.5), ["date", "instrument"]).join(features.daily_return(dense), ["date", "instrument"]))


@query
def default_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.default_factors(_dense(spark, sf_dir)))


@query
def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 20 rows of two features, with the sums of both."""
    s = features.sequences(_dense(spark, sf_dir), ["close", "volume"], 20)
    total = lambda k: F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[k]), 4)
    return s.select("date", "instrument", total(0).alias("closes"), total(1).alias("volumes"))


@query
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir)
    names = ["ret_1d", "vol_5d", "ma_diff_5_20"]
    cells = features.technical_features(dense).select("date", "instrument", *names).join(features.rank_target(dense, 5), ["date", "instrument"])
    return features.boosted_scores(cells.filter("date < '1996-01-01'"), cells.filter("date >= '1996-01-01'"), names, "target_rank", trees=3, depth=3)


def _roll(f: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {least} THEN {f}({x}) OVER {_w(n)} END"


_FILLED = f"""{_panel('brand')}, f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM g),
    b AS (SELECT *, c / nullif(lag(c) OVER {_O}, 0) - 1 AS r, close - lag(close) OVER {_O} AS change, amount / (volume + 1e-10) AS vwap FROM f)"""
_MA = {n: f"({_roll('avg', 'close', n, least)})" for n, least in ((5, 3), (10, 5), (20, 10))}
_VOL = {n: f"({_roll('avg', 'volume', n, least)})" for n, least in ((5, 3), (20, 10))}
_HI, _LO, _VW = f"({_roll('max', 'high', 20, 10)})", f"({_roll('min', 'low', 20, 10)})", f"({_roll('avg', 'vwap', 5, 3)})"
_RAW = {
    **{f"ret_{n}d": f"c / nullif(lag(c, {n}) OVER {_O}, 0) - 1" for n in (1, 5, 10, 20)}, **{f"vol_{n}d": _roll("stddev_samp", "r", n, max(3, n // 2)) for n in (5, 10, 20)},
    "turnover_5d": f"volume / nullif({_VOL[5]}, 0)", "turnover_20d": f"volume / nullif({_VOL[20]}, 0)", "volume_ratio_5_20": f"{_VOL[5]} / nullif({_VOL[20]}, 0)",
    "rsi_14": f"100 - 100 / (1 + ({_roll('avg', 'greatest(change, 0)', 14, 7)}) / (({_roll('avg', 'greatest(-change, 0)', 14, 7)}) + 1e-10))".replace("greatest(change, 0)", "CASE WHEN change IS NOT NULL THEN greatest(change, 0) END").replace("greatest(-change, 0)", "CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END"),
    **{f"ma_{n}": s for n, s in _MA.items()}, "ma_diff_5_20": f"({_MA[5]} - {_MA[20]}) / ({_MA[20]} + 1e-10)", "price_above_ma5": f"CASE WHEN close > {_MA[5]} THEN 1.0 ELSE 0.0 END", "price_above_ma20": f"CASE WHEN close > {_MA[20]} THEN 1.0 ELSE 0.0 END",
    "high_low_range_10d": f"({_HI} - {_LO}) / ({_LO} + 1e-10)", "close_to_high_20d": f"({_HI} - close) / ({_HI} - {_LO} + 1e-10)", "close_to_low_20d": f"(close - {_LO}) / ({_HI} - {_LO} + 1e-10)", "vwap_dev_5d": f"(close - {_VW}) / ({_VW} + 1e-10)",
}
ORACLE_SQL["raw_features"] = f"{_FILLED} SELECT date, instrument, {', '.join(f'round(CAST({s} AS DOUBLE), 6) AS {k}' for k, s in _RAW.items())} FROM b"
ORACLE_SQL["default_factors"] = f"""{_FILLED}, z AS (SELECT *, coalesce(r, 0) AS q FROM b) SELECT date, instrument, round({_roll('sum', 'q', 20, 20)}, 6) AS momentum_20d, round(-({_roll('sum', 'q', 5, 5)}), 6) AS mean_reversion_5d, round(-({_roll('stddev_samp', 'q', 20, 20)}), 6) AS volatility_20d,
    round(coalesce(volume / nullif(({_roll('avg', 'volume', 20, 20)}), 0) - 1, 0), 6) AS volume_zscore, round({_roll('sum', 'q', 5, 5)}, 6) AS momentum_5d, round(coalesce(close / nullif(({_roll('min', 'close', 10, 10)}), 0) - 1, 0), 6) AS high_low_spread FROM z"""
ORACLE_SQL["model_targets"] = f"""{_FILLED}, t AS (SELECT date, instrument, r, lead(close, 5) OVER {_O} / nullif(close, 0) - 1 AS x FROM b)
    SELECT date, instrument, round(CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(x) OVER d END, 6) AS target_rank,
        round(CASE WHEN x IS NULL THEN NULL WHEN stddev_samp(x) OVER d IS NULL THEN x ELSE least(greatest(x, avg(x) OVER d - 1.5 * stddev_samp(x) OVER d), avg(x) OVER d + 1.5 * stddev_samp(x) OVER d) END, 6) AS forward_return, round(r, 6) AS daily_return
    FROM t WINDOW d AS (PARTITION BY date)"""
ORACLE_SQL["feature_sequences"] = f"""{_panel('brand')}, f AS (SELECT date, instrument, i, coalesce(last_value(close IGNORE NULLS) OVER p, 0) AS c, coalesce(last_value(volume IGNORE NULLS) OVER p, 0) AS v FROM g WINDOW p AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT date, instrument, round(sum(c) OVER {_w(20)}, 4) AS closes, round(sum(v) OVER {_w(20)}, 4) AS volumes FROM f QUALIFY i >= 19"""


# --- choice and fusion of factors -------------------------------------------


@query
def normalised_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(learned.normalised_ic(exposures(spark, sf_dir)))


@query
def ensemble_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = exposures(spark, sf_dir)
    return _rounded(learned.ensemble_ic(cells, fusion.factor_weights(reports.ic_summary(reports.paired_ic(cells)).select("factor", F.col("mean_ic").alias("ic"), "icir", F.lit(0).alias("place")))))


@query
def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of three factors over all earlier dates, five of embargo."""
    wide = exposures(spark, sf_dir).groupBy("date", "instrument").pivot("factor", ["momentum", "reach", "volume"]).agg(F.first("value")).join(exposures(spark, sf_dir).filter("factor = 'reach'").select("date", "instrument", "target"), ["date", "instrument"])
    names = ["momentum", "reach", "volume"]
    return _rounded(learned.walk_forward_scores(wide, names, learned.walk_forward_weights(wide, names, 5)))


@query
def fused_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(learned.fused_portfolio(exposures(spark, sf_dir), "1996-01-01", 8))


@query
def five_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.five_scores(exposures(spark, sf_dir), "1996-01-01"))


@query
def factor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.clusters(reports.ic_matrix(exposures(spark, sf_dir)), 2)


@query
def factor_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted figures of three factors as predictions of the return, by the row's month."""
    cells = exposures(spark, sf_dir).select("factor", F.col("target").alias("y"), (F.col("value") / 1000).alias("predicted"), F.month("date").alias("w"))
    return _rounded(selection.fitness(cells))


@query
def champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.factor_report(exposures(spark, sf_dir), 5, 12).withColumnRenamed("turnover", "turnover").withColumn("spread", F.lit(0.0))
    return _rounded(selection.champion(report).select("factor", "score"))


@query
def relative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of suppliers taken as factors against parts taken as the repository."""
    s, p = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = s.select(F.col("s_suppkey").cast("string").alias("factor"), (F.col("s_suppkey") % 97).alias("ic"), (F.col("s_suppkey") % 31).alias("ir"), (F.col("s_suppkey") % 13).alias("turnover"), (F.col("s_suppkey") % 7).alias("diversity"))
    held = p.select((F.col("p_partkey") % 101).alias("ic"), (F.col("p_partkey") % 29).alias("ir"), (F.col("p_partkey") % 11).alias("turnover"), (F.col("p_partkey") % 9).alias("diversity"))
    return _rounded(selection.relative_scores(asked, held))


ORACLE_SQL["relative_scores"] = f"""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS factor, s_suppkey % 97 AS ic, s_suppkey % 31 AS ir, s_suppkey % 13 AS turnover, s_suppkey % 7 AS diversity FROM supplier),
    p AS (SELECT p_partkey % 101 AS ic, p_partkey % 29 AS ir, p_partkey % 11 AS turnover, p_partkey % 9 AS diversity FROM part)
    SELECT factor, {', '.join(f'round((SELECT count(*) FROM p WHERE p.{m} {">" if m == "turnover" else "<"} s.{m}) / (SELECT count(*) FROM p)::DOUBLE * 10, 6) AS {m}' for m in ('ic', 'ir', 'turnover', 'diversity'))} FROM s"""
ORACLE_SQL["factor_fitness"] = f"""{_LONG}, k AS (SELECT factor, target AS y, value / 1000 AS p, CAST(month(date) AS DOUBLE) AS w FROM known),
    r AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY y) + (count(*) OVER (PARTITION BY factor, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY factor ORDER BY p) + (count(*) OVER (PARTITION BY factor, p) - 1) / 2.0 AS rp FROM k),
    m AS (SELECT factor, sum(w) AS t, sum(w * y) / sum(w) AS my, sum(w * p) / sum(w) AS mp, sum(w * ry) / sum(w) AS mry, sum(w * rp) / sum(w) AS mrp FROM r GROUP BY factor)
    SELECT factor, round(coalesce(abs(sum(w * (y - my) * (p - mp)) / nullif(sqrt(sum(w * (y - my) ** 2) * sum(w * (p - mp) ** 2)), 0)), 0), 6) AS pearson, round(coalesce(abs(sum(w * (ry - mry) * (rp - mrp)) / nullif(sqrt(sum(w * (ry - mry) ** 2) * sum(w * (rp - mrp) ** 2)), 0)), 0), 6) AS spearman,
        round(sum(w * abs(p - y)) / sum(w), 6) AS mae, round(sum(w * (p - y) ** 2) / sum(w), 6) AS mse, round(sqrt(sum(w * (p - y) ** 2) / sum(w)), 6) AS rmse,
        round(sum(-w * (y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(least(greatest(1 - p, 1e-15), 1 - 1e-15)))) / sum(w), 6) AS log_loss FROM r JOIN m USING (factor) GROUP BY factor"""


@query
def cluster_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three suppliers of the largest balance, by size, in each nation."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("factor"), F.col("s_nationkey").alias("cluster"), F.col("s_acctbal").alias("ic"))
    return selection.best_of_groups(s, 3)


ORACLE_SQL["cluster_chains"] = "SELECT CAST(s_suppkey AS VARCHAR) AS factor, s_nationkey AS cluster, s_acctbal AS ic, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC, CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place FROM supplier QUALIFY place <= 3"


# --- panels, files and portfolios --------------------------------------------


@query
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panels.densify(panels.supplier_panel(spark, sf_dir)).select("date", "instrument", panels.interpolate("close").alias("close")))


ORACLE_SQL["interpolated"] = f"""{_panel('supplier')}, k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER p AS a, first_value(CASE WHEN close IS NOT NULL THEN i END IGNORE NULLS) OVER n AS b, last_value(close IGNORE NULLS) OVER p AS x, first_value(close IGNORE NULLS) OVER n AS y
    FROM g WINDOW p AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT date, instrument, round(coalesce(close, x + (i - a) / nullif(b - a, 0)::DOUBLE * (y - x), x), 6) AS close FROM k"""


@query
def split_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each side of a split by date with six dates of context."""
    train, test = panels.split(_dense(spark, sf_dir), F.lit("1996-01-01").cast("date"), 6)
    return train.groupBy("date").agg(F.count("*").alias("n")).select("date", F.lit("train").alias("side"), "n").union(test.groupBy("date", "is_context").agg(F.count("*").alias("n")).select("date", F.when(F.col("is_context"), "context").otherwise("test"), "n"))


ORACLE_SQL["split_panel"] = f"""{_panel('brand')}, d AS (SELECT date, count(*) AS n, row_number() OVER (ORDER BY date) AS k FROM g GROUP BY date), f AS (SELECT min(k) AS k FROM d WHERE date >= DATE '1996-01-01')
    SELECT date, 'train' AS side, n FROM d, f WHERE d.k < f.k UNION ALL SELECT date, CASE WHEN d.k < f.k THEN 'context' ELSE 'test' END, n FROM d, f WHERE d.k >= f.k - 6"""


@query
def stepped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest price of an order's line, as a report of its supplier, on the first day of each month of the panel."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    news = lines.select(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"))
    grid = panels.densify(panels.supplier_panel(spark, sf_dir)).select("date", "instrument")
    return files.stepped(grid, news, ["price"])


ORACLE_SQL["stepped_reports"] = f"""{_panel('supplier')}, n AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
    SELECT g.date, g.instrument, n.price FROM g ASOF LEFT JOIN n ON g.instrument = n.instrument AND g.date >= n.date"""


@query
def idle_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per date once dates without any close are gone; closes of every other month are taken away before."""
    holes = _dense(spark, sf_dir).withColumn("close", F.when(F.month("date") % 2 == 0, F.col("close")))
    return panels.drop_idle_dates(holes).groupBy("date").agg(F.count("*").alias("n"))


ORACLE_SQL["idle_dates"] = f"{_panel('brand')} SELECT date, count(*) AS n FROM g WHERE month(date) % 2 = 0 GROUP BY date HAVING count(close) > 0"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("date", "instrument", F.round("volume", 6).alias("score"))


@query
def held_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(portfolio.held_returns(portfolio.build(_scores(spark, sf_dir), 6), _dense(spark, sf_dir)))


@query
def simple_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.simple_performance(portfolio.build(_scores(spark, sf_dir), 6), _dense(spark, sf_dir), 12)


ORACLE_SQL["held_returns"] = f"""{_panel('brand')}, b AS (SELECT date, instrument, round(volume, 6) AS s FROM g WHERE volume IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY s DESC, instrument) <= 6),
    w AS (SELECT date, instrument, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM b), d AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM w))
    SELECT w.date, round(sum(w.w * (y.close / x.close - 1)) / sum(w.w), 6) AS ret FROM w JOIN d USING (date) JOIN g x ON x.date = w.date AND x.instrument = w.instrument JOIN g y ON y.date = d.next AND y.instrument = w.instrument
    WHERE x.close IS NOT NULL AND y.close IS NOT NULL GROUP BY w.date HAVING count(*) >= 3"""


@query
def family_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as factors of the family of their nation: at most two of each, every nation's first before all others."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("factor"), F.col("s_nationkey").alias("family"), F.col("s_acctbal").alias("icir"))
    return reports.family_balanced(s, 30, 2)


ORACLE_SQL["family_choice"] = """WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS factor, s_nationkey AS family, s_acctbal AS icir, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC, CAST(s_suppkey AS VARCHAR)) AS k FROM supplier)
    SELECT factor, family, icir FROM p WHERE k <= 2 ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, abs(icir) DESC, factor LIMIT 30"""


@query
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.describe(spark.read.parquet(f"{sf_dir}/supplier.parquet"), ["s_acctbal", "s_nationkey"]))


ORACLE_SQL["described"] = "SELECT 's_acctbal' AS metric, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS dev FROM supplier UNION ALL SELECT 's_nationkey', round(avg(s_nationkey), 6), round(stddev_pop(s_nationkey), 6) FROM supplier"

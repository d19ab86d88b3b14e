"""The registered panel queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import core, library
from factorloom.operators import memory, portfolio, retrieval, scoring, vector_index
from factorloom.sources import panels
from factorloom.streaming import bars as stream

_TIE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_LINES = {"brand": "SELECT p_brand AS instrument, l.* FROM lineitem l JOIN part ON l_partkey = p_partkey", "supplier": "SELECT CAST(l_suppkey AS VARCHAR) AS instrument, l.* FROM lineitem l"}


def _panel(kind: str) -> str:
    """WITH clauses of a monthly panel p and its dense form g, whose row numbers are i."""
    return f"""WITH lines AS ({_LINES[kind]}),
        p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, instrument, first(l_extendedprice / l_quantity ORDER BY {_TIE}) AS open,
            max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_TIE}) AS close,
            sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lines GROUP BY ALL),
        g AS (SELECT d.date, n.instrument, open, high, low, close, volume, amount, row_number() OVER (PARTITION BY n.instrument ORDER BY d.date) - 1 AS i
            FROM (SELECT DISTINCT date FROM p) d CROSS JOIN (SELECT DISTINCT instrument FROM p) n LEFT JOIN p ON p.date = d.date AND p.instrument = n.instrument)"""


def _w(n: int) -> str:
    return f"(PARTITION BY instrument ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_O = "(PARTITION BY instrument ORDER BY date)"
_RANK = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"


def _gate(sql: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} >= {least} THEN {sql} END"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _columns(name: str, columns: dict[str, tuple[Callable[[], Column], str]], kind: str = "supplier", into: tuple[dict, dict] | None = None) -> None:
    """A query of several columns over the dense panel, rounded, and its SQL; registered here or in other tables of both."""
    known, oracles = into or (QUERIES, ORACLE_SQL)
    read = panels.brand_panel if kind == "brand" else panels.supplier_panel

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        dense = panels.densify(read(spark, sf_dir))
        return dense.select("date", "instrument", *[F.round(c().cast("double"), 6).alias(k) for k, (c, _) in columns.items()])

    known[name] = query
    oracles[name] = f"{_panel(kind)} SELECT date, instrument, {', '.join(f'round(CAST({s} AS DOUBLE), 6) AS {k}' for k, (_, s) in columns.items())} FROM g"


def _register() -> None:
    n = 6
    w, w5 = _w(n), _w(5)
    _columns("d1_cross_section", {"rank_close": (lambda: core.rank("close"), _RANK.format(x="close")), "scaled": (lambda: core.scale("close"), "close / nullif(sum(abs(close)) OVER (PARTITION BY date), 0)")})
    _columns("d1_rolling", {
        "ts_mean": (lambda: core.ts_mean("close", n), _gate(f"avg(close) OVER {w}", "close", n, 3)), "ts_sum": (lambda: core.ts_sum("volume", n), _gate(f"sum(volume) OVER {w}", "volume", n, 3)),
        "ts_min": (lambda: core.ts_min("low", n), _gate(f"min(low) OVER {w}", "low", n, 3)), "ts_max": (lambda: core.ts_max("high", n), _gate(f"max(high) OVER {w}", "high", n, 3)),
        "ts_std": (lambda: core.ts_std("volume", n), _gate(f"stddev_pop(volume) OVER {w}", "volume", n, 4)), "ts_var": (lambda: core.ts_var("volume", n), _gate(f"var_pop(volume) OVER {w}", "volume", n, 4)),
        "ts_product": (lambda: core.ts_product(F.col("volume") / 30, 3), _gate(f"product(volume / 30) OVER {_w(3)}", "volume", 3, 2)),
    })
    _columns("d1_pairs", {
        "corr": (lambda: core.ts_corr("close", "volume", n), _gate(f"covar_pop(close, volume) OVER {w} / nullif(stddev_pop(close) OVER {w} * stddev_pop(volume) OVER {w}, 0)", "close", n, 3)),
        "cov": (lambda: core.ts_cov("close", "volume", n), _gate(f"covar_samp(close, volume) OVER {w}", "close", n, 3)),
    })
    _columns("d1_lags", {
        "delay": (lambda: core.delay("close", 2), f"lag(close, 2) OVER {_O}"), "ts_delta": (lambda: core.ts_delta("close", 2), f"close - lag(close, 2) OVER {_O}"),
        "ts_pct_change": (lambda: core.ts_pct_change("close", 2), f"(close - lag(close, 2) OVER {_O}) / nullif(lag(close, 2) OVER {_O}, 0)"),
    })
    cells = f"list(close) FILTER (close IS NOT NULL) OVER {w5}"
    pct = f"(len(list_filter({cells}, lambda v: v < close)) + (len(list_filter({cells}, lambda v: v = close)) + 1) / 2.0) / len({cells})"
    _columns("d1_ts_rank", {"ts_rank": (lambda: core.ts_rank("close", 5), f"CASE WHEN close IS NOT NULL THEN {_gate(pct + ' / 5', 'close', 5, 2)} END")})
    _columns("d1_arg_decay", {
        "argmax": (lambda: core.ts_argmax("close", n), _gate(f"{n - 1} - (arg_max(i, CASE WHEN close IS NOT NULL THEN row(close, -i) END) OVER {w} - greatest(i - {n - 1}, 0))", "close", n, 3)),
        "argmin": (lambda: core.ts_argmin("close", n), _gate(f"{n - 1} - (arg_min(i, CASE WHEN close IS NOT NULL THEN row(close, i) END) OVER {w} - greatest(i - {n - 1}, 0))", "close", n, 3)),
        "decay_linear": (lambda: core.decay_linear("volume", n), _gate(f"(sum(volume * i) OVER {w} + ({n} - i) * sum(volume) OVER {w}) / (least(i + 1, {n}) * {n} - least(i + 1, {n}) * (least(i + 1, {n}) - 1) / 2.0)", "volume", n, 3)),
        "ts_slope": (lambda: core.ts_slope("volume", n), _gate(f"(sum(volume * i) OVER {w} - greatest(i - {n - 1}, 0) * sum(volume) OVER {w} - {(n - 1) / 2} * sum(volume) OVER {w}) / {n * (n * n - 1) / 12}", "volume", n, 4)),
        "ts_zscore": (lambda: core.ts_zscore("volume", n), _gate(f"CASE WHEN volume IS NULL THEN NULL WHEN stddev_pop(volume) OVER {w} = 0 THEN 0 ELSE (volume - avg(volume) OVER {w}) / stddev_pop(volume) OVER {w} END", "volume", n, 5)),
    })
    _columns("d1_row_functions", {
        "sign": (lambda: core.sign(F.col("close") - F.col("open")), "sign(close - open)"), "abs": (lambda: F.abs(F.col("close") - F.col("open")), "abs(close - open)"),
        "log": (lambda: core.log(F.col("close") - F.col("open")), "CASE WHEN close - open IS NOT NULL THEN ln(greatest(close - open, 1e-10)) END"),
        "sqrt": (lambda: core.sqrt(F.col("close") - F.col("open")), "CASE WHEN close - open IS NOT NULL THEN sqrt(greatest(close - open, 0.0)) END"),
        "signedpower": (lambda: core.signedpower((F.col("close") - F.col("open")) / 1000, 2), "sign((close - open) / 1000) * pow(abs((close - open) / 1000), 2)"),
        "if_": (lambda: core.if_(core.greater("close", "open"), "high", "low"), "CASE WHEN close > open THEN high ELSE low END"),
        "ele_min": (lambda: core.ele_min("close", "open"), "least(close, open)"), "ele_max": (lambda: core.ele_max("close", "open"), "greatest(close, open)"),
    })
    _columns("d2_windows", {
        "median": (lambda: library.TS_MEDIAN("close", 5), f"quantile_cont(close, 0.5) OVER {w5}"), "quantile": (lambda: library.TS_QUANTILE("close", 5, 0.3), f"quantile_cont(close, 0.3) OVER {w5}"),
        "std": (lambda: library.TS_STD("volume", 5), f"stddev_samp(volume) OVER {w5}"), "var": (lambda: library.TS_VAR("volume", 5), f"var_samp(volume) OVER {w5}"),
        "zscore": (lambda: library.TS_ZSCORE("volume", 5), f"(volume - avg(volume) OVER {w5}) / nullif(stddev_samp(volume) OVER {w5}, 0)"),
        "count": (lambda: library.COUNT(F.col("close") > F.col("open"), 5), f"sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER {w5}"),
        "sumif": (lambda: library.SUMIF("volume", 5, F.col("close") > F.col("open")), f"sum(volume * CASE WHEN close > open THEN 1 WHEN close <= open THEN 0 END) OVER {w5}"),
        "log1p": (lambda: library.LOG("volume"), "ln(volume + 1)"), "pctchange": (lambda: library.TS_PCTCHANGE("close", 1), f"coalesce((close - lag(close) OVER {_O}) / nullif(lag(close) OVER {_O}, 0), 0)"),
        "bb_upper": (lambda: library.BB_UPPER("volume", 5), f"avg(volume) OVER {w5} + stddev_samp(volume) OVER {w5}"), "bb_lower": (lambda: library.BB_LOWER("volume", 5), f"avg(volume) OVER {w5} - stddev_samp(volume) OVER {w5}"),
        "regbeta": (lambda: library.REGBETA("close", "volume", 5), f"CASE WHEN i >= 4 THEN covar_pop(coalesce(close, 0), coalesce(volume, 0)) OVER {w5} / nullif(var_pop(coalesce(volume, 0)) OVER {w5}, 0) END"),
    })
    _columns("p_fill_and_targets", {
        "filled": (lambda: panels.forward_fill("close"), f"last_value(close IGNORE NULLS) OVER {_O}"), "fwd3": (lambda: panels.forward_return(3), f"lead(close, 3) OVER {_O} / nullif(close, 0) - 1"),
        "typical": (lambda: (F.col("high") + F.col("low") + F.col("close")) / 3, "(high + low + close) / 3"), "vwap": (lambda: F.try_divide("amount", "volume"), "amount / nullif(volume, 0)"),
    })
    for name, c in {"d1_moments": {"skew": lambda: core.ts_skew("volume", 8), "kurt": lambda: core.ts_kurt("volume", 8)}, "d1_ts_decay": {"decay": lambda: core.ts_decay("close", 5)}, "d2_ema_macd_mad": {"ema": lambda: library.EMA("close", 5), "macd": lambda: library.MACD("close"), "mad": lambda: library.TS_MAD("close", 5), "highday": lambda: library.HIGHDAY("close", 5), "lowday": lambda: library.LOWDAY("close", 5), "regresi": lambda: library.REGRESI("close", "volume", 5)}}.items():
        _columns(name, {k: (x, "0") for k, x in c.items()})
        del ORACLE_SQL[name]  # moments differ in the last digits, recursions have no SQL; tests hold them against pandas


_register()


def factor_cells(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    """date, instrument, factor and target of -1 * correlation(rank(open), rank(volume), 10) over brands and months."""
    dense = panels.densify(panels.brand_panel(spark, sf_dir))
    ranked = dense.select("*", core.rank("open").alias("ro"), core.rank("volume").alias("rv"))
    return ranked.select("date", "instrument", "close", F.round(-core.ts_corr("ro", "rv", 10), 10).alias("factor"), panels.forward_return(horizon).alias("target"))


_CELLS = f"""{_panel('brand')},
    r AS (SELECT *, {_RANK.format(x='open')} AS ro, {_RANK.format(x='volume')} AS rv FROM g),
    cells AS (SELECT date, instrument, close, round({_gate(f"-covar_pop(ro, rv) OVER {_w(10)} / nullif(stddev_pop(ro) OVER {_w(10)} * stddev_pop(rv) OVER {_w(10)}, 0)", "ro", 10, 5)}, 10) AS factor, lead(close, 5) OVER {_O} / nullif(close, 0) - 1 AS target FROM r)"""


def ic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ic_summary(scoring.daily_ic(factor_cells(spark, sf_dir))).select("n", *[F.round(c, 6).alias(c) for c in ("mean_ic", "icir", "win_rate")])


def quantile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.quantile_spread(factor_cells(spark, sf_dir)).select("date", F.round("spread", 6).alias("spread"))


def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank_stability(factor_cells(spark, sf_dir)).select("date", F.round("stability", 6).alias("stability"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = panels.supplier_panel(spark, sf_dir).select("date", "instrument", F.col("close").alias("factor")).join(panels.supplier_industry(spark, sf_dir), "instrument")
    return cells.select("date", "instrument", *[F.round(c, 6).alias(k) for k, c in (("z", scoring.zscore()), ("minmax", scoring.minmax()), ("residual", scoring.industry_residual()))])


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.capped(portfolio.top_n(factor_cells(spark, sf_dir).withColumnRenamed("factor", "score"), 8, proportional=True), 0.3, 0.01)


def top_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).select("date", "instrument", F.round("weight", 6).alias("weight"))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = panels.densify(panels.brand_panel(spark, sf_dir)).select("date", "instrument", "close")
    return portfolio.backtest(prices, _targets(spark, sf_dir), 3, 0.001).select("date", *[F.round(c, 8).alias(c) for c in ("ret", "nav", "turnover")])


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.metrics(backtest(spark, sf_dir), periods=12)


def winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.winsorize(panels.supplier_panel(spark, sf_dir), "close").select("date", "instrument", F.round("close", 6).alias("close"))


def sigma_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.clip_sigma(panels.supplier_panel(spark, sf_dir), "close", 1.5).select("date", "instrument", F.round("close", 6).alias("close"))


def memory_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return retrieval.nearest(memory, memory.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5).select("query_id", "vec_id", "place")


def memory_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As memory_nearest, with every row as a query, by an index that leaves out what can't be near."""
    return vector_index.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 5).select("query_id", "vec_id", "place")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.daily_bars(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("amount", F.round("amount", 4))


def market_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regimes of the mean close of brands alone."""
    return memory.market_state(memory.market_proxy(panels.densify(panels.brand_panel(spark, sf_dir))))


QUERIES |= {f.__name__: f for f in (ic_report, quantile_spread, rank_stability, normalised, top_weights, backtest, backtest_metrics, winsorized, sigma_clipped, memory_nearest, memory_neighbours, event_bars, market_states)}
#: The SQL of market regimes over a table m (date, close, rate, matching).
REGIMES = """r AS (SELECT *, row_number() OVER o AS k, close / nullif(lag(close) OVER o, 0) - 1 AS r, lag(close, 4) OVER o AS was FROM m WINDOW o AS (ORDER BY date)),
    s AS (SELECT *, CASE WHEN k > 20 THEN stddev_samp(r) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END AS dev,
        avg(close) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / avg(close) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ratio FROM r)
    SELECT date, CASE WHEN dev IS NULL THEN 'medium' WHEN dev < 0.15 THEN 'low' WHEN dev < 0.25 THEN 'medium' ELSE 'high' END AS volatility,
        CASE WHEN rate IS NULL THEN 'normal' WHEN rate < 2 THEN 'abundant' WHEN rate < 3.5 THEN 'normal' ELSE 'tight' END AS liquidity,
        CASE WHEN k < 5 THEN 'sideways' WHEN k < 60 THEN CASE WHEN close > was THEN 'bull' ELSE 'bear' END WHEN ratio > 1.02 THEN 'bull' WHEN ratio < 0.98 THEN 'bear' ELSE 'sideways' END AS trend,
        CASE WHEN matching IS NULL THEN 'medium' WHEN matching < 0.3 THEN 'low' WHEN matching < 0.6 THEN 'medium' ELSE 'high' END AS correlation FROM s"""
ORACLE_SQL["market_states"] = f"{_panel('brand')}, m AS (SELECT date, avg(close) AS close, NULL AS rate, NULL AS matching FROM g GROUP BY date HAVING avg(close) IS NOT NULL), {REGIMES}"
ORACLE_SQL |= {
    "ic_report": f"""{_CELLS}, k AS (SELECT date, {_RANK.format(x='factor')} AS f, {_RANK.format(x='target')} AS t FROM cells),
        c AS (SELECT date, f - avg(f) OVER (PARTITION BY date) AS f, t - avg(t) OVER (PARTITION BY date) AS t FROM k),
        d AS (SELECT date, sum(f * t) / nullif(sqrt(sum(f * f)) * sqrt(sum(t * t)), 0) AS ic FROM c GROUP BY date)
        SELECT count(ic) AS n, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM d WHERE ic IS NOT NULL""",
    "quantile_spread": f"""{_CELLS}, k AS (SELECT * FROM cells WHERE factor IS NOT NULL AND target IS NOT NULL),
        e AS (SELECT date, count(*) AS n, list_sort(list_distinct(quantile_cont(factor, [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]))) AS e FROM k GROUP BY date)
        SELECT date, round(avg(target) FILTER (factor > e[-2]) - avg(target) FILTER (factor <= e[2]), 6) AS spread FROM k JOIN e USING (date) WHERE n >= 15 AND len(e) > 2 GROUP BY date""",
    "rank_stability": f"""{_CELLS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS j FROM (SELECT DISTINCT date FROM cells)),
        k AS (SELECT instrument, date, j, {_RANK.format(x='factor')} AS r FROM cells JOIN d USING (date))
        SELECT a.date, round(1 - avg(abs(a.r - b.r)), 6) AS stability FROM k a JOIN k b ON a.instrument = b.instrument AND a.j = b.j + 1 WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.date HAVING count(*) >= 3""",
    "normalised": f"""{_panel('supplier')}, k AS (SELECT date, instrument, close AS x, r_name AS ind FROM p JOIN supplier ON instrument = CAST(s_suppkey AS VARCHAR) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT date, instrument, round(CASE WHEN count(x) OVER d < 5 THEN x ELSE (x - avg(x) OVER d) / (stddev_samp(x) OVER d + 1e-8) END, 6) AS z,
            round(CASE WHEN max(x) OVER d - min(x) OVER d <= 1e-8 THEN 0.5 ELSE (x - min(x) OVER d) / (max(x) OVER d - min(x) OVER d) END, 6) AS minmax,
            round(CASE WHEN ind = min(ind) OVER d THEN x ELSE x - avg(x) OVER (PARTITION BY date, ind) END, 6) AS residual FROM k WINDOW d AS (PARTITION BY date)""",
    "top_weights": f"""{_CELLS}, b AS (SELECT date, instrument, factor AS s FROM cells WHERE factor IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY factor DESC, instrument) <= 8),
        v AS (SELECT date, instrument, s - min(s) OVER (PARTITION BY date) + 1e-6 AS v FROM b), x AS (SELECT date, instrument, least(v / sum(v) OVER (PARTITION BY date), 0.3) AS w FROM v),
        y AS (SELECT * FROM (SELECT date, instrument, w / sum(w) OVER (PARTITION BY date) AS w FROM x) WHERE w >= 0.01) SELECT date, instrument, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM y""",
    "winsorized": f"""{_panel('supplier')}, e AS (SELECT instrument, quantile_cont(close, [0.03, 0.97]) AS e FROM p GROUP BY instrument) SELECT date, instrument, round(least(greatest(close, e[1]), e[2]), 6) AS close FROM p JOIN e USING (instrument)""",
    "sigma_clipped": f"""{_panel('supplier')} SELECT date, instrument, round(CASE WHEN stddev_samp(close) OVER k IS NULL THEN close ELSE least(greatest(close, avg(close) OVER k - 1.5 * stddev_samp(close) OVER k), avg(close) OVER k + 1.5 * stddev_samp(close) OVER k) END, 6) AS close FROM p WINDOW k AS (PARTITION BY instrument)""",
    "memory_nearest": """WITH s AS (SELECT q.vec_id AS query_id, m.vec_id, round(list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings m JOIN embeddings q ON q.vec_id < 5 AND q.vec_id != m.vec_id)
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS place FROM s QUALIFY place <= 5""",
    "memory_neighbours": """WITH s AS (SELECT q.vec_id AS query_id, m.vec_id, round(list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings m JOIN embeddings q ON q.vec_id != m.vec_id)
        SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS place FROM s QUALIFY place <= 5""",
    "event_bars": """SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS instrument, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume, round(sum(value), 4) AS amount FROM events GROUP BY ALL""",
}

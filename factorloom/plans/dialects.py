"""Queries of the formula functions' other dialects, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import core, expression, library, numeric, sampled, ticker
from factorloom.plans.queries import _O, _RANK, _columns, _gate, _w
from factorloom.sources import panels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_N = 5
_W = _w(_N)
_LAG = f"lag(close, {_N}) OVER {_O}"
_CORR = "covar_pop({a}, {b}) OVER {w} / nullif(stddev_pop({a}) OVER {w} * stddev_pop({b}) OVER {w}, 0)"


def _add(name: str, columns: dict) -> None:
    _columns(name, columns, into=(QUERIES, ORACLE_SQL))


def _full(sql: str, x: str = "close") -> str:
    return _gate(sql, x, _N, _N)


def _sum_by(weights: list[float], x: str = "close") -> str:
    return " + ".join(f"{w!r} * lag({x}, {len(weights) - 1 - k}) OVER {_O}" for k, w in enumerate(weights))


def _register() -> None:
    day = "(PARTITION BY date)"
    cells = f"list(close) FILTER (close IS NOT NULL) OVER {_W}"
    _add("d3_rolling", {
        "mean": (lambda: expression.ts_mean("close", _N), _full(f"avg(close) OVER {_W}")), "total": (lambda: expression.ts_sum("volume", _N), _full(f"sum(volume) OVER {_W}")),
        "top": (lambda: expression.ts_max("close", _N), _full(f"max(close) OVER {_W}")), "low": (lambda: expression.ts_min("close", _N), _full(f"min(close) OVER {_W}")),
        "med": (lambda: expression.ts_med("close", 4), _gate(f"list_sort(list(close) FILTER (close IS NOT NULL) OVER {_w(4)})[2]", "close", 4, 4)),
        "std": (lambda: expression.ts_std("volume", _N), _full(f"stddev_samp(volume) OVER {_W}", "volume")), "var": (lambda: expression.ts_var("volume", _N), _full(f"var_samp(volume) OVER {_W}", "volume")),
        "ir": (lambda: expression.ts_ir("volume", _N), _full(f"avg(volume) OVER {_W} / nullif(stddev_samp(volume) OVER {_W}, 0)", "volume")),
        "spread": (lambda: expression.ts_min_max_diff("close", _N), _full(f"max(close) OVER {_W} - min(close) OVER {_W}")), "from_top": (lambda: expression.ts_max_diff("close", _N), _full(f"close - max(close) OVER {_W}")), "from_low": (lambda: expression.ts_min_diff("close", _N), _full(f"close - min(close) OVER {_W}")),
    })
    powers = [(1 - 2 / (1 + _N)) ** k for k in range(_N, 0, -1)]
    _add("d3_weighted", {
        "rank": (lambda: expression.ts_rank("close", _N), _full(f"(len(list_filter({cells}, lambda v: v > close)) + len(list_filter({cells}, lambda v: v >= close)) + 1) / {2.0 * _N}")),
        "mad": (lambda: expression.ts_mad("volume", 3), _gate(" + ".join(f"abs(lag(volume, {k}) OVER {_O} - avg(volume) OVER {_w(3)})" for k in range(3)).join(("(", ") / 3")), "volume", 3, 3)),
        "wma": (lambda: expression.ts_wma("volume", _N), _full(_sum_by([2 * k / (_N * (_N - 1)) for k in range(_N)], "volume"), "volume")), "ema": (lambda: expression.ts_ema("volume", _N), _full(_sum_by([p / sum(powers) for p in powers], "volume"), "volume")),
        "delta": (lambda: expression.ts_delta("close", _N), f"close - {_LAG}"), "ratio": (lambda: expression.ts_div("close", _N), f"close / nullif({_LAG}, 0)"), "change": (lambda: expression.ts_pctchange("close", _N), f"close / nullif({_LAG}, 0) - 1"),
        "cov": (lambda: expression.ts_cov("open", "volume", _N), _full(f"covar_samp(open, volume) OVER {_W}", "open")), "corr": (lambda: expression.ts_corr("open", "volume", _N), _full(_CORR.format(a="open", b="volume", w=_W), "open")),
        "ref": (lambda: expression.ref("close", -2), f"lead(close, 2) OVER {_O}"),
    })
    _add("d3_row_functions", {
        "place": (lambda: expression.cs_rank("volume"), f"CASE WHEN volume IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY volume NULLS LAST, instrument) - 1) / count(volume) OVER {day} END"), "inverse": (lambda: expression.inv("volume"), "1 / nullif(volume, 0)"),
        "log1p": (lambda: expression.s_log1p(F.col("close") - F.col("open")), "sign(close - open) * ln(1 + abs(close - open))"), "larger": (lambda: expression.greater("close", "open"), "greatest(close, open)"), "smaller": (lambda: expression.less("close", "open"), "least(close, open)"),
    })
    warm = lambda sql: f"CASE WHEN i >= {_N - 1} THEN {sql} END"
    floor = f"greatest(abs({_LAG}), 1e-8)"
    place = f"CASE WHEN volume IS NULL THEN 0 ELSE coalesce((({_RANK.format(x='volume')}) * count(volume) OVER {day} - 1) / nullif(count(volume) OVER {day} - 1, 0), 0) END"
    _add("d3_numeric", {
        "mean": (lambda: numeric.ts_mean("close", _N), warm(f"avg(close) OVER {_W}")), "total": (lambda: numeric.ts_sum("volume", _N), warm(f"coalesce(sum(volume) OVER {_W}, 0)")), "med": (lambda: numeric.ts_med("close", _N), warm(f"quantile_cont(close, 0.5) OVER {_W}")),
        "std": (lambda: numeric.ts_std("volume", _N), warm(f"stddev_pop(volume) OVER {_W}")), "var": (lambda: numeric.ts_var("volume", _N), warm(f"var_pop(volume) OVER {_W}")), "top": (lambda: numeric.ts_max("close", _N), warm(f"max(close) OVER {_W}")), "low": (lambda: numeric.ts_min("close", _N), warm(f"min(close) OVER {_W}")),
        "cov": (lambda: numeric.ts_cov("open", "volume", _N), warm(f"covar_pop(open, volume) OVER {_W}")), "ratio": (lambda: numeric.ts_div("close", _N), f"CASE WHEN {_LAG} IS NOT NULL THEN close / {floor} END"), "change": (lambda: numeric.ts_pctchange("close", _N), f"CASE WHEN {_LAG} IS NOT NULL THEN (close - {_LAG}) / {floor} END"),
        "place": (lambda: numeric.cs_rank("volume"), place), "rank": (lambda: numeric.ts_rank("volume", _N), warm(place)),
        "wma": (lambda: numeric.ts_wma("volume", _N), warm(f"(sum(volume * i) OVER {_W} - (i - {_N}) * sum(volume) OVER {_W}) / {_N * (_N + 1) / 2}")),
        "larger": (lambda: numeric.greater("close", "open"), "CASE WHEN close > open THEN 1 ELSE 0 END"), "smaller": (lambda: numeric.less("close", "open"), "CASE WHEN close < open THEN 1 ELSE 0 END"),
        "quotient": (lambda: numeric.div("close", F.col("close") - F.col("open")), "CASE WHEN abs(close - open) < 1e-8 THEN 0 ELSE close / nullif(close - open, 0) END"), "log": (lambda: numeric.log("volume"), "CASE WHEN volume IS NOT NULL THEN ln(greatest(volume, 1e-8)) END"),
    })
    least = lambda sql, x="close": _gate(sql, x, _N, 2)
    _add("d4_sampled", {
        "mean": (lambda: sampled.Mean("close", _N), least(f"avg(close) OVER {_W}")), "total": (lambda: sampled.Sum("volume", _N), least(f"sum(volume) OVER {_W}")), "low": (lambda: sampled.Min("close", _N), least(f"min(close) OVER {_W}")), "top": (lambda: sampled.Max("close", _N), least(f"max(close) OVER {_W}")),
        "std": (lambda: sampled.Std("volume", _N), least(f"stddev_samp(volume) OVER {_W}", "volume")), "med": (lambda: sampled.Med("close", _N), least(f"quantile_cont(close, 0.5) OVER {_W}")), "rank": (lambda: sampled.Rank("close", 9), _RANK.format(x="close")),
        "corr": (lambda: sampled.Corr("open", "volume", _N), least(_CORR.format(a="open", b="volume", w=_W), "open")), "cov": (lambda: sampled.Cov("open", "volume", _N), least(f"covar_samp(open, volume) OVER {_W}", "open")),
        "delta": (lambda: sampled.Delta("close", 1), f"close - lag(close) OVER {_O}"), "sigmoid": (lambda: sampled.Sigmoid(F.col("close") - F.col("open")), "CASE WHEN close IS NOT NULL THEN 1 / (1 + exp(-greatest(-50.0, least(50.0, close - open)))) END"),
    })
    own = "(PARTITION BY instrument)"
    _add("d5_ticker", {
        "place": (lambda: ticker.rank("volume"), f"CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY instrument, volume IS NULL ORDER BY volume) - 1 + (count(*) OVER (PARTITION BY instrument, volume) - 1) / 2.0) / nullif(count(volume) OVER {own} - (len(list_filter(list(volume) OVER {own}, lambda v: v = max(volume) OVER {own})) - 1) / 2.0 - 1, 0) END"),
        "score": (lambda: ticker.scale("volume"), f"(volume - avg(volume) OVER {own}) / nullif(stddev_pop(volume) OVER {own}, 0)"), "ts_rank": (lambda: ticker.ts_rank("close", _N), _full(f"len(list_filter({cells}, lambda v: v < close)) + 1")),
        "decay": (lambda: ticker.decay_linear("volume", _N), f"(sum(volume * i) OVER {_W} - (i - least(i + 1, {_N})) * sum(volume) OVER {_W}) / least(i + 1, {_N})"), "total": (lambda: ticker.ts_sum("volume", _N), f"sum(volume) OVER {_W}"), "low": (lambda: ticker.ts_min("close", _N), f"min(close) OVER {_W}"), "top": (lambda: ticker.ts_max("close", _N), f"max(close) OVER {_W}"), "sma": (lambda: ticker.sma("close", _N), f"avg(close) OVER {_W}"), "std": (lambda: ticker.stddev("volume", _N), f"stddev_pop(volume) OVER {_W}"),
        "argmax": (lambda: ticker.ts_argmax("close", _N), f"arg_max(i, CASE WHEN close IS NOT NULL THEN row(close, -i) END) OVER {_W} - greatest(i - {_N - 1}, 0)"), "argmin": (lambda: ticker.ts_argmin("close", _N), f"arg_min(i, CASE WHEN close IS NOT NULL THEN row(close, i) END) OVER {_W} - greatest(i - {_N - 1}, 0)"),
        "corr": (lambda: ticker.correlation("open", "volume", _N), f"coalesce({_CORR.format(a='open', b='volume', w=_W)}, 0)"), "cov": (lambda: ticker.covariance("open", "volume", _N), f"covar_samp(open, volume) OVER {_W}"), "log": (lambda: ticker.log(F.col("high") - F.col("low")), "coalesce(ln(nullif(high - low, 0)), 0)"),
        "denominator": (lambda: ticker.safe_denominator(F.col("high") - F.col("low")), "CASE WHEN high - low = 0 THEN 0.0001 ELSE high - low END"),
    })
    n = 4
    short = lambda ws, total: "CASE least(i + 1, 4) " + " ".join(f"WHEN {m} THEN ({_sum_by(ws[:m], 'volume')}){f' / {sum(ws[:m])!r}' if total else ''}" for m in range(1, n + 1)) + " END"
    _add("d2_more", {
        "day_mean": (lambda: library.collapsed("close", "mean"), f"avg(close) OVER {day}"), "day_std": (lambda: library.collapsed("volume", "std"), f"stddev_samp(volume) OVER {day}"), "day_median": (lambda: library.collapsed("close", "median"), f"quantile_cont(close, 0.5) OVER {day}"),
        "history": (lambda: library.PERCENTILE("close", 0.25), f"quantile_cont(close, 0.25) OVER {own}"), "sumac": (lambda: library.SUMAC("volume"), f"sum(volume) OVER {_w(10)}"), "sma": (lambda: library.SMA("close", 5), f"avg(close) OVER {_W}"),
        "wma": (lambda: library.WMA("volume", n), short([0.9**k for k in range(n - 1, -1, -1)], True)), "decay": (lambda: library.DECAYLINEAR("volume", n), short([2 * k / (n * (n + 1)) for k in range(1, n + 1)], False)),
        "prod": (lambda: library.PROD("close", "volume"), "close * volume"), "kept": (lambda: library.FILTER("close", F.col("close") > F.col("open")), "close * CASE WHEN close > open THEN 1 WHEN close <= open THEN 0 END"), "inv": (lambda: library.INV("volume"), "1 / nullif(volume, 0)"),
        "middle": (lambda: library.BB_MIDDLE("volume", 5), f"avg(volume) OVER {_W}"), "dynamic": (lambda: library.BB_MIDDLE(F.coalesce("volume", F.lit(0.0)), F.lit(3)), f"avg(coalesce(volume, 0)) OVER {_w(3)}"),
    })
    # The SQL of moments is in oracles, as is that of recursions.
    for name, columns in {
        "d3_moments": {"skew": lambda: expression.ts_skew("volume", 6), "kurt": lambda: expression.ts_kurt("volume", 6), "mad": lambda: numeric.ts_mad("volume", 5), "floored_corr": lambda: numeric.ts_corr("open", "volume", 5), "floored_ir": lambda: numeric.ts_ir("volume", 5)},
        "d4_moments": {"skew": lambda: sampled.Skew("volume", 8), "kurt": lambda: sampled.Kurt("volume", 8), "mad": lambda: sampled.Mad("volume", 8)},
    }.items():
        _add(name, {k: (x, "0") for k, x in columns.items()})
        del ORACLE_SQL[name]


def recursions(dense: DataFrame) -> DataFrame:
    """library.RSI("close"), library.SMA("close", 6, 2.0) and ticker.atr() of a dense panel, whose windows are made once and share three sorts."""
    up, down = library.moves(F.col("_change"))
    cells = dense.withColumns({"_i": core._row(), "_change": core.ts_delta("close", 1), "_span": ticker.widest()}).withColumns({"_up": up, "_down": down})
    cells = core.with_ewm_recursive(cells, "atr", "_span", 2 / 15)
    cells = core.with_ewm_adjusted(cells, {"_rise": ("_up", 2 / 15), "_fall": ("_down", 2 / 15), "sma": ("close", 2.0 / 6)})
    return cells.withColumn("rsi", library.strength(F.col("_rise"), F.col("_fall"))).select("date", "instrument", "rsi", "sma", "atr")


def d2_recursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = recursions(panels.densify(panels.supplier_panel(spark, sf_dir)))
    return cells.select("date", "instrument", *[F.round(c, 6).alias(c) for c in ("rsi", "sma", "atr")])


_register()
QUERIES["d2_recursions"] = d2_recursions

"""Queries of reports, families, splits and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import numeric, scalar
from factorloom.operators import evaluation
from factorloom.plans import reports as plans
from factorloom.plans.queries import _CELLS, _O, _RANK, _columns, _panel, _w, factor_cells
from factorloom.sources import panels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPLIT = "1996-01-01"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.densify(panels.brand_panel(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def page_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the pages' pieces between tags have words of each family."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.split(F.coalesce("html", F.lit("")), "<")).alias("piece"))
    return pages.groupBy(evaluation.family("piece").alias("family")).agg(F.count("*").alias("n"))


_WORDS = " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{k}'" for k, w in evaluation.FAMILIES.items())
ORACLE_SQL["page_families"] = f"SELECT CASE {_WORDS} ELSE 'Other' END AS family, count(*) AS n FROM (SELECT lower(unnest(string_split(coalesce(html, ''), '<'))) AS t FROM pages) GROUP BY 1"


@query
def market_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.market_return(_dense(spark, sf_dir)), 8)


ORACLE_SQL["market_return"] = f"""{_panel('brand')}, r AS (SELECT date, lead(close) OVER {_O} / nullif(last_value(close IGNORE NULLS) OVER {_O}, 0) - 1 AS r FROM g)
    SELECT date, round(avg(r), 8) AS market FROM r GROUP BY date HAVING avg(r) IS NOT NULL"""


@query
def split_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.split_ic(plans.exposures(spark, sf_dir), SPLIT, 10))


ORACLE_SQL["split_ic"] = f"""{plans._PAIRED.format(least=10)}, parts AS (SELECT CASE WHEN date <= DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS part, factor, count(*) AS days, avg(spearman) AS mean_ic FROM ic WHERE spearman IS NOT NULL GROUP BY ALL)
    SELECT part, factor, days, round(mean_ic, 6) AS mean_ic, CAST(row_number() OVER (PARTITION BY part ORDER BY mean_ic DESC, factor) AS INTEGER) AS place FROM parts"""


@query
def signed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.signed_spread(factor_cells(spark, sf_dir)))


_IC = f"""rk AS (SELECT date, {_RANK.format(x='factor')} AS f, {_RANK.format(x='target')} AS t FROM {{cells}}), ct AS (SELECT date, f - avg(f) OVER (PARTITION BY date) AS f, t - avg(t) OVER (PARTITION BY date) AS t FROM rk),
    ic AS (SELECT date, sum(f * t) / nullif(sqrt(sum(f * f)) * sqrt(sum(t * t)), 0) AS ic FROM ct GROUP BY date)"""
ORACLE_SQL["signed_spread"] = f"""{_CELLS}, {_IC.format(cells='cells')}, k AS (SELECT * FROM cells WHERE factor IS NOT NULL AND target IS NOT NULL),
    e AS (SELECT date, count(*) AS n, list_sort(list_distinct(quantile_cont(factor, [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]))) AS e FROM k GROUP BY date),
    sp AS (SELECT date, avg(target) FILTER (factor > e[-2]) - avg(target) FILTER (factor <= e[2]) AS spread FROM k JOIN e USING (date) WHERE n >= 15 AND len(e) > 2 GROUP BY date)
    SELECT (SELECT count(spread) FROM sp) AS days, round(avg(ic), 6) AS ic, round(coalesce(sign(avg(ic)), 0) * (SELECT avg(spread) FROM sp), 6) AS spread FROM ic WHERE ic IS NOT NULL"""


@query
def composite_test_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sum of momentum and reach as score."""
    dense = _dense(spark, sf_dir)
    scores = plans.exposures(spark, sf_dir).filter("factor != 'volume'").groupBy("date", "instrument").agg(F.sum("value").alias("score"))
    return _rounded(evaluation.composite_test_ic(scores, dense, 3, SPLIT))


ORACLE_SQL["composite_test_ic"] = f"""{plans._LONG}, sc AS (SELECT date, instrument, sum(value) AS factor FROM x WHERE factor <> 'volume' AND date >= DATE '{SPLIT}' GROUP BY date, instrument),
    ah AS (SELECT date, instrument, lead(close, 3) OVER {_O} / nullif(close, 0) - 1 AS target FROM g), cells AS (SELECT sc.date, sc.instrument, factor, target FROM sc JOIN ah ON ah.date = sc.date AND ah.instrument = sc.instrument), {_IC.format(cells='cells')}
    SELECT count(ic) AS n, round(avg(ic), 6) AS mean_rank_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir FROM ic WHERE ic IS NOT NULL"""


@query
def finished_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over holding the five brands of the largest volume, against the mean of all."""
    dense = _dense(spark, sf_dir)
    market = evaluation.market_return(dense)
    held = plans.exposures(spark, sf_dir).filter("factor = 'volume' and value is not null").withColumn("place", F.expr("row_number() OVER (PARTITION BY date ORDER BY value DESC, instrument)")).filter("place <= 5")
    ahead = dense.select("date", "instrument", F.expr("try_divide(lead(close) OVER (PARTITION BY instrument ORDER BY date), close) - 1").alias("ret"))
    daily = held.select("date", "instrument").join(ahead, ["date", "instrument"]).groupBy("date").agg(F.avg("ret").alias("ret")).filter("ret is not null").join(market, "date")
    return _rounded(evaluation.portfolio_report(daily, 12))


ORACLE_SQL["finished_portfolio"] = f"""{_panel('brand')},
    n AS (SELECT *, lead(close) OVER {_O} / nullif(close, 0) - 1 AS ret, lead(close) OVER {_O} / nullif(last_value(close IGNORE NULLS) OVER {_O}, 0) - 1 AS any_ret, CASE WHEN volume IS NOT NULL THEN row_number() OVER (PARTITION BY date, volume IS NULL ORDER BY volume DESC, instrument) END AS place FROM g),
    m AS (SELECT date, avg(any_ret) AS market FROM n GROUP BY date HAVING avg(any_ret) IS NOT NULL),
    d AS (SELECT date, avg(ret) AS ret, any_value(market) AS market FROM n JOIN m USING (date) WHERE place <= 5 GROUP BY date HAVING avg(ret) IS NOT NULL),
    v AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS nav, 1 + sum(ret) OVER (ORDER BY date) AS line FROM d),
    w AS (SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS down, line / max(line) OVER (ORDER BY date) - 1 AS simple FROM v),
    s AS (SELECT count(*) AS n, product(1 + ret) AS nav, avg(ret) AS mean, avg(market) AS mm, stddev_samp(ret) AS dev, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS ddev, min(down) AS max_drawdown, min(simple) AS simple_drawdown, avg(ret - market) AS over_, stddev_samp(ret - market) AS odev,
        avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, covar_samp(ret, market) / (var_pop(market) + 1e-8) AS beta FROM w)
    SELECT round(pow(nav, 12.0 / n) - 1, 6) AS annual_return, round((mean - beta * mm) * 12, 6) AS alpha, round(mean / dev * sqrt(12), 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(simple_drawdown, 6) AS simple_drawdown, round((pow(nav, 12.0 / n) - 1) / abs(max_drawdown), 6) AS calmar,
        round(over_ / odev * sqrt(12), 6) AS information_ratio, round(win_rate, 6) AS win_rate, round(mean / ddev * sqrt(12), 6) AS sortino, round(beta, 6) AS beta FROM s"""


@query
def finished_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over each of three factors."""
    return _rounded(evaluation.factor_report(plans.exposures(spark, sf_dir), _dense(spark, sf_dir), 5, 12))


ORACLE_SQL["finished_factors"] = f"""{plans._SUMMARY.replace('>= 10', '>= 3')},
    hold AS (SELECT x.factor, x.date, r.ret FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, instrument) AS place FROM x WHERE value IS NOT NULL) x
        JOIN (SELECT date, instrument, lead(close) OVER {_O} / nullif(close, 0) - 1 AS ret FROM g) r ON r.date = x.date AND r.instrument = x.instrument WHERE place <= 5),
    hd AS (SELECT factor, date, avg(ret) AS ret FROM hold GROUP BY ALL HAVING avg(ret) IS NOT NULL), hn AS (SELECT *, product(1 + ret) OVER (PARTITION BY factor ORDER BY date) AS nav FROM hd),
    hw AS (SELECT *, nav / max(nav) OVER (PARTITION BY factor ORDER BY date) - 1 AS down FROM hn)
    SELECT s.factor, s.days, round(s.mean_ic, 6) AS ic, round(s.icir, 6) AS icir, round(any_value(h.sharpe), 6) AS sharpe, round(any_value(h.max_drawdown), 6) AS max_drawdown, round(any_value(h.win_rate), 6) AS win_rate
    FROM s JOIN (SELECT factor, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 0) AS sharpe, min(down) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM hw GROUP BY factor) h USING (factor) GROUP BY ALL"""


def _scalars() -> None:
    x, y = "(close / 1000 - 15)", "(open / 1000 - 15)"
    sx, sy = lambda: F.col("close") / 1000 - 15, lambda: F.col("open") / 1000 - 15
    one = {
        "neg": f"-{x}", "abs": f"abs({x})", "sin": f"sin({x})", "cos": f"cos({x})", "tan": f"tan({x})", "exp": f"exp({x})", "n2": f"{x} * {x}", "n3": f"{x} * {x} * {x}", "n4": f"{x} * {x} * {x} * {x}", "inv": f"1 / nullif({x}, 0)", "expneg": f"exp(-{x})", "sigmoid": f"1 / (1 + exp(-{x}))",
        "log": f"CASE WHEN {x} > 0 THEN ln({x}) END", "logabs": f"CASE WHEN {x} <> 0 THEN ln(abs({x})) END",
    }
    two = {"add": f"{x} + {y}", "sub": f"{x} - {y}", "mul": f"{x} * {y}", "max": f"greatest({x}, {y})", "min": f"least({x}, {y})"}
    columns = {f"plain_{k}": (lambda k=k: scalar.PLAIN[k](sx()), s) for k, s in one.items()}
    columns |= {f"two_{k}": (lambda k=k: scalar.PROTECTED[k](sx(), sy()), s if k not in ("max", "min") else f"coalesce({s}, NULL)") for k, s in two.items()}
    columns |= {"wrap_abs": (lambda: scalar.WRAPS["abs"](sx()), f"abs({x})"), "wrap_neg": (lambda: scalar.WRAPS["neg"](sx()), f"-{x}"), "join_add": (lambda: scalar.JOINS["add"](sx(), sy()), two["add"]), "join_sub": (lambda: scalar.JOINS["sub"](sx(), sy()), two["sub"]), "join_mul": (lambda: scalar.JOINS["mul"](sx(), sy()), two["mul"])}
    guarded = lambda k, s, c, other: (lambda: scalar.GUARDED[k](sx()), f"CASE WHEN {c} THEN {s} WHEN {x} IS NOT NULL THEN {other} END")
    columns |= {"guarded_exp": guarded("exp", f"exp({x})", f"{x} < 100", 0), "guarded_n2": guarded("n2", one["n2"], f"abs({x}) < 1e6", 0), "guarded_n3": guarded("n3", one["n3"], f"abs({x}) < 1e6", 0), "guarded_sigmoid": (lambda: scalar.GUARDED["sigmoid"](sx()), f"CASE WHEN {x} > -100 THEN 1 / (1 + exp(-{x})) WHEN {x} IS NOT NULL THEN 1 END")}
    _columns("scalar_functions", {k: (lambda f=f: F.when(~F.isnan(v := f().cast("double")), v), s) for k, (f, s) in columns.items()}, "brand", (QUERIES, ORACLE_SQL))


_scalars()


@query
def recursive_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive mean of the full-window dialect over the closes of brands."""
    return _dense(spark, sf_dir).select("date", "instrument", F.round(numeric.ts_ema("close", 5), 6).alias("ema"))


ORACLE_SQL["recursive_ema"] = f"""{_panel('brand').replace('WITH lines', 'WITH RECURSIVE lines', 1)}, s AS (SELECT *, avg(close) OVER {_w(5)} AS seed FROM g),
    e AS (SELECT instrument, i, seed AS y FROM s WHERE i = 4
        UNION ALL SELECT s.instrument, s.i, CASE WHEN close IS NULL THEN y WHEN y IS NULL THEN close ELSE close / 3 + y * 2 / 3 END FROM e JOIN s ON s.instrument = e.instrument AND s.i = e.i + 1)
    SELECT s.date, s.instrument, round(y, 6) AS ema FROM s LEFT JOIN e ON s.instrument = e.instrument AND s.i = e.i"""

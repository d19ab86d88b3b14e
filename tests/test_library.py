"""Formula libraries, memory, features, selection and learned weights: against their SQL, pandas and small cases."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import alphas, core, formulas
from factorloom.operators import features, learned, memory, portfolio, retrieval, selection
from factorloom.plans import library, oracles
from factorloom.sources import files, panels
from tests.test_queries import SF, duck, spark  # noqa: F401

KEYS = ("factor", "factor_id", "metric", "cluster", "side", "date", "instrument", "query_id", "place")


def ordered(f: pd.DataFrame) -> pd.DataFrame:
    f = f[sorted(f.columns)].copy()
    if "date" in f:
        f["date"] = pd.to_datetime(f["date"])
    return f.sort_values([k for k in KEYS if k in f]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = ordered(library.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(library.ORACLE_SQL[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8, atol=2e-6)


# --- formulas against pandas ---


@pytest.fixture(scope="module")
def cells(spark):  # noqa: F811
    rng = np.random.default_rng(8)
    days = pd.bdate_range("2020-01-01", periods=90)
    names = [f"s{i:02d}" for i in range(12)]
    close = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (90, 12)), axis=0)), days, names)
    wide = {"close": close, "open": close * (1 + rng.normal(0, 0.01, close.shape)), "volume": pd.DataFrame(rng.lognormal(10, 1, close.shape), days, names)}
    wide["high"], wide["low"] = np.maximum(close, wide["open"]) * 1.01, np.minimum(close, wide["open"]) * 0.99
    wide["vwap"] = (wide["high"] + wide["low"] + close) / 3
    wide["close"] = wide["close"].mask(rng.random(close.shape) < 0.03)
    wide["returns"] = wide["close"].ffill().pct_change()
    long = pd.concat({k: v.stack(future_stack=True) for k, v in wide.items()}, axis=1).rename_axis(["date", "instrument"]).reset_index()
    long["date"] = long["date"].dt.date
    frame = spark.createDataFrame(long.astype(object).where(long.notna(), None), "date date, instrument string, " + ", ".join(f"{k} double" for k in wide))
    return wide, frame


def rolled(n, least, f):
    return lambda x: getattr(x.rolling(n, min_periods=least), f)()


def as_float(x):
    return x.astype(float)


def names_of(wide):
    """The core functions on wide frames, by pandas."""

    def correlation(x, y, n):
        a, b = x.where(y.notna()), y.where(x.notna())
        return a.rolling(n, min_periods=min(max(3, n // 2), n)).corr(b).replace([np.inf, -np.inf], np.nan)

    def ts_rank(x, n):
        return x.rolling(n, min_periods=min(max(2, n // 2), n)).rank(pct=True) / n

    def decay_linear(x, n):
        def one(v):
            w = np.arange(n - len(v) + 1, n + 1)
            return np.nansum(w * v) / w.sum()
        return pd.concat([x] * 1).rolling(n, min_periods=min(max(2, n // 2), n)).apply(one, raw=True)

    mean = lambda f: lambda x, n: rolled(n, max(1, n // 2), f)(x)
    third = lambda n: min(max(2, 2 * n // 3), n)
    known = {
        **wide, "rank": lambda x: as_float(x).rank(axis=1, pct=True), "correlation": correlation, "ts_rank": ts_rank, "decay_linear": decay_linear, "ts_mean": mean("mean"), "ts_sum": mean("sum"), "ts_min": mean("min"), "ts_max": mean("max"),
        "ts_std": lambda x, n: x.rolling(n, min_periods=third(n)).std(ddof=0), "delay": lambda x, n: x.shift(n), "ts_delta": lambda x, n: x - x.shift(n), "sign": np.sign, "abs": abs, "sqrt": lambda x: np.sqrt(x.clip(lower=0)), "log": lambda x: np.log(x.clip(lower=1e-10)),
        "ele_min": lambda x, y: x.where(y.isna() | (x <= y), y).where(x.notna()), "scale": lambda x: x.div(x.abs().sum(axis=1), axis=0), "where": lambda c, a, b: (a if isinstance(a, pd.DataFrame) else c * 0.0 + a).where(c.astype(bool), b),
    }
    short = {"mean": "ts_mean", "total": "ts_sum", "least": "ts_min", "most": "ts_max", "std": "ts_std", "delta": "ts_delta", "corr": "correlation", "corr0": "correlation", "place": "ts_rank", "fade": "decay_linear", "level": "ts_mean", "lower": "ele_min", "ln": "log", "year": "ts_sum"}
    return known | {k: known[v] for k, v in short.items()} | {"or0": lambda x: x, "or1": lambda x: x, "safe": lambda x, _: x, "below": lambda a, b: (a < b).astype(float)}


PLAIN = ["alpha002", "alpha003", "alpha004", "alpha005", "alpha006", "alpha011", "alpha012", "alpha018", "alpha023", "alpha025", "alpha028", "alpha033", "alpha035", "alpha040", "alpha041", "alpha042", "alpha053", "alpha055", "alpha067", "alpha080", "alpha088", "alpha097", "alpha101"]


def test_formulas_against_pandas(cells):
    wide, frame = cells
    got = formulas.exposures(frame, {k: alphas.PANEL_ALPHAS[k] for k in PLAIN}, alphas.PANEL_DIALECT).toPandas()
    got["date"] = pd.to_datetime(got["date"])
    for k in PLAIN:
        want = alphas.PANEL_ALPHAS[k](SimpleNamespace(**names_of(wide)))
        mine = got.pivot(index="date", columns="instrument", values=k)
        close = np.isclose(mine.to_numpy(float), want.to_numpy(float), rtol=1e-6, atol=1e-8, equal_nan=True)
        assert close.mean() > 0.99, (k, close.mean())


def test_whole_library(cells):
    _, frame = cells
    got = formulas.exposures(frame, alphas.PANEL_ALPHAS, alphas.PANEL_DIALECT).toPandas()
    assert len(alphas.PANEL_ALPHAS) == 98 and len(got) == 90 * 12
    some = got.notna().any()
    assert {k for k in alphas.PANEL_ALPHAS if not some[k]} <= LONG


#: Formulas whose windows are longer than the sample.
LONG = {"alpha019", "alpha024", "alpha032", "alpha036", "alpha037", "alpha039", "alpha052", "alpha061", "alpha064", "alpha071", "alpha079"}


def test_seeds_against_pandas(cells):
    wide, frame = cells
    got = formulas.seeds(frame).toPandas()
    got["date"] = pd.to_datetime(got["date"])
    close, high, low = wide["close"], wide["high"], wide["low"]
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    change = close.diff()
    rsi = 100 - 100 / (1 + ema(change.where(change > 0, 0), 10) / (ema((-change).where(change < 0, 0), 10) + 1e-10))
    last = close.shift()
    atr = ema(pd.DataFrame(np.maximum.reduce([(high - low).values, (high - last).fillna(0).values, (low - last).fillna(0).values]), close.index, close.columns), 14)
    spread = ema(high - low, 10)
    want = {"InverseRSI": 100 - rsi, "RSIMomentum": rsi - rsi.shift(14), "ATR": atr, "ATRMomentum": atr - atr.shift(14), "EMA20_minus_Close": ema(close, 20) - close, "HL_EMA_ratio": spread / (spread.shift(10) + 1e-10) - 1, "Price_vs_SMA14_delay7": close - close.rolling(14, min_periods=1).mean().shift(7)}
    for k, w in want.items():
        np.testing.assert_allclose(got.pivot(index="date", columns="instrument", values=k).to_numpy(float), w.to_numpy(float), rtol=1e-7, atol=1e-9, err_msg=k)
    assert len(formulas.SEEDS) == 35


@pytest.mark.parametrize("alpha", [0.05, 0.3, 2 / 3, 1.0])
@pytest.mark.parametrize("fall", [160.0, 460.0])
def test_exponential_means_with_gaps(spark, monkeypatch, alpha, fall):  # noqa: F811
    monkeypatch.setattr(core, "_FALL", fall)
    rng = np.random.default_rng(6)
    x = pd.Series(rng.normal(5, 2, 400)).mask(rng.random(400) < 0.3)
    x[100:160] = np.nan
    x[0] = np.nan
    frame = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), "a", None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "date date, instrument string, x double")
    got = frame.select("date", core.ewm_adjusted("x", alpha).alias("a"), core.ewm_recursive("x", alpha).alias("r")).orderBy("date").toPandas()
    np.testing.assert_allclose(got["a"].to_numpy(float), x.ewm(alpha=alpha).mean().to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(got["r"].to_numpy(float), x.ewm(alpha=alpha, adjust=False).mean().to_numpy(), rtol=1e-9)


# --- features, memory, learned weights ---


def test_comparable_features(cells):
    wide, frame = cells
    got = features.comparable(frame.select("date", "instrument", "close", "volume")).toPandas()
    for c in ("close", "volume"):
        x = wide[c]
        med = x.median(axis=1)
        width = 3 * 1.4826 * x.sub(med, axis=0).abs().median(axis=1)
        cut = x.clip(med - width, med + width, axis=0)
        want = cut.sub(cut.mean(axis=1), axis=0).div(cut.std(axis=1) + 1e-10, axis=0)
        np.testing.assert_allclose(got.pivot(index="date", columns="instrument", values=c).to_numpy(float), want.to_numpy(), rtol=1e-8, atol=1e-10)


def test_memory_falls_back_and_counts(spark):  # noqa: F811
    held = library._memory(spark, "/root/testdata/sf0.001").withColumn("last_retrieved", F.lit(None).cast("string"))
    asked = held.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("market_state").alias("now"))
    found = memory.retrieve(held, asked, 3, least_ic=9.0)
    assert found.count() == 3
    after = memory.noted(held, found, F.lit("now")).filter("last_retrieved = 'now'")
    assert {r.factor_id for r in after.collect()} == {r.factor_id for r in found.collect()}
    assert memory.text_vectors(spark.createDataFrame([("a rising trend",), (None,)], "description string"), size=16).select(F.size("embedding")).distinct().first()[0] == 16
    assert spark.range(1).select(memory.factor_id(F.lit("x"))).first()[0] == "2d711642b726b044"


def test_walk_forward_is_least_squares(cells):
    wide, frame = cells
    names, embargo = ["open", "volume"], 3
    panel = frame.withColumn("target", panels.forward_return(embargo))
    got = {r.date: r for r in learned.walk_forward_weights(panel, names, embargo, 30).collect()}
    rows = panel.toPandas().astype({"target": float})
    days = sorted(rows["date"].unique())
    for i in (4, 20, 60, 80):
        part = rows[rows["date"].isin(days[max(0, i - 30) : i - embargo])].dropna(subset=[*names, "target"])
        x = np.column_stack([part[names].to_numpy(float), np.ones(len(part))])
        want = np.linalg.lstsq(x, part["target"].to_numpy(), rcond=None)[0]
        assert got[days[i]].n == len(part)
        np.testing.assert_allclose(x @ np.array(got[days[i]].weights), x @ want, atol=1e-6)
    assert got[days[0]].weights is None


def test_pool_weights():
    assert learned.pool_weights({"a": 0.1}, {}) == {"a": 1.0}
    w = learned.pool_weights({"a": 0.5, "b": 0.1, "c": 0.5}, {("a", "c"): 0.99, ("b", "a"): 0.0})
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0 and w["b"] < w["a"]


def test_selection(spark):  # noqa: F811
    f = spark.createDataFrame([("a", 0.1, None, None, 1.0, -0.1), ("b", 0.2, -0.1, 2.0, 0.1, -0.5), ("c", 0.0, 0.05, 0.2, 3.0, -0.2)], "factor string, ic double, val_ic double, val_sharpe double, sharpe double, max_drawdown double")
    names = lambda df: sorted(r.factor for r in df.collect())
    assert names(selection.quality_gate(f, 0.05)) == ["a", "b"]
    assert names(selection.quality_gate(f, 0.0, 0.0, 0.1)) == ["c"]
    assert names(selection.quality_gate(f, 9.0)) == ["b"]
    assert names(selection.quality_gate(f, 9.0, 0.0)) == ["c"]
    assert names(selection.best(f, 2)) == ["a", "b"]
    assert [r.factor for r in selection.numbered(spark.createDataFrame([("x", 2), ("x", 1), ("y", 1)], "factor string, n int")).orderBy("n", "factor").collect()] == ["x", "y", "x__dup1"]
    pools = [spark.createDataFrame([("e1", 1.0)], "expression string, ic double"), spark.createDataFrame([("e1", 9.0), ("e2", 2.0)], "expression string, ic double")]
    assert {(r.expression, r.ic) for r in selection.united(pools).collect()} == {("e1", 1.0), ("e2", 2.0)}
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", None)], "date int, instrument string, value double")
    assert selection.equal_factors(a, a).first().equal and not selection.equal_factors(a, a.withColumn("value", F.col("value") + 1)).first().equal
    cold = selection.relative_scores(spark.createDataFrame([("a", 0.04, 0.1, 0.5, 0.2)], "factor string, ic double, ir double, turnover double, diversity double"), spark.createDataFrame([], "ic double, ir double, turnover double, diversity double")).first()
    assert (cold.ic, cold.ir, cold.turnover, cold.diversity) == (7.0, 3.0, 5.0, 8.0)
    s = selection.normalised_scores(spark.createDataFrame([("a", 0.025, 5.0, 0.25, 1.5, 1.0), ("b", -0.3, 0.0, 0.0, 0.0, 0.0)], "factor string, effectiveness double, stability double, turnover double, diversity double, overfitting double")).orderBy("factor").collect()
    assert s[0][1:] == pytest.approx((0.65, 1.0, 0.5, 1.0, 1.0)) and s[1][1:] == pytest.approx((0.0, 0.5, 0.0, 0.0, 0.0))


def test_files(spark, cells, tmp_path):  # noqa: F811
    _, frame = cells
    path = files.write_archive(frame, str(tmp_path), "u", "a", "b")
    assert files.read_archive(spark, str(tmp_path), "u", "a", "b").count() == frame.count() and path.endswith("u_a_b")
    assert files.capped_universe(frame, 3).select("instrument").distinct().count() == 3
    files.write_table(frame, f"{tmp_path}/t", 2)
    assert spark.read.parquet(f"{tmp_path}/t/debug").select("instrument").distinct().count() == 2 and "$close" in spark.read.parquet(f"{tmp_path}/t/all").columns
    train, test = files.tail_split(frame, 0.2)
    assert train.select("date").distinct().count() == 72 and test.select("date").distinct().count() == 18
    info = {r.side: r.dates for r in files.write_split(train.select("date", "instrument", "close"), test.select("date", "instrument", "close"), f"{tmp_path}/s").collect()}
    assert info == {"train": 72, "test": 18}
    nav = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", float("inf"))], "d string, portfolio_value double")
    files.write_results(f"{tmp_path}/r", nav, nav, nav, nav)
    assert [r.nav for r in files.read_nav(spark, f"{tmp_path}/r/daily").orderBy("date").collect()] == [1.0, None]
    held = library._memory(spark, "/root/testdata/sf0.001")
    files.save_memory(held, f"{tmp_path}/m")
    assert files.load_memory(spark, f"{tmp_path}/m", held).select(held.columns).exceptAll(held).count() == 0
    raw = frame.select(F.col("date").alias("Date"), F.col("instrument").alias("ticker"), F.col("close").alias("Close"), "high", "low", F.col("volume").alias("Vol"), F.lit(None).cast("double").alias("none"))
    raw.write.parquet(f"{tmp_path}/bars")
    bars = files.read_bars(spark, f"{tmp_path}/bars")
    assert {"date", "instrument", "close", "volume", "vwap", "returns"} <= set(bars.columns) and "none" not in bars.columns and bars.filter("close is null").count() == 0


def test_portfolio_rules(spark):  # noqa: F811
    d = [dt.date(2020, 1, i) for i in range(1, 5)]
    s = spark.createDataFrame([(d[0], "a", 3.0), (d[0], "b", 2.0), (d[0], "c", 1.0), (d[1], "a", 1.0)], "date date, instrument string, score double")
    off = spark.createDataFrame([(d[0], "a")], "date date, instrument string")
    assert {(r.instrument, r.weight) for r in portfolio.build(s, 2, off).filter(F.col("date") == d[0]).collect()} == {("b", 0.5), ("c", 0.5)}
    assert portfolio.build(s, 3, off).filter(F.col("date") == d[0]).count() == 0
    assert portfolio.rebalance_dates(s, 30).count() == 1 and portfolio.rebalance_dates(s, 300).count() == 2
    assert portfolio.weighted(s, 2, "equal").filter("weight = 0.5").count() == 2
    daily = spark.createDataFrame([(d[0], 0.1, 1.1, 0.0), (d[1], -0.1, 0.99, 0.4), (d[2], 0.2, 1.188, 0.2), (d[3], 0.0, 1.188, 0.9)], "date date, ret double, nav double, turnover double")
    m = portfolio.metrics(daily, 252, 0.0, 2).first()
    assert m.win_rate == pytest.approx(2 / 3) and m.avg_turnover == 0.2 and m.total_return == pytest.approx(0.188) and m.volatility == pytest.approx(np.std([0.1, -0.1, 0.2], ddof=1) * 252**0.5)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE_SQL) - {"alpha_library", "seed_library"}))
def test_other_queries_have_sound_figures(spark, name):  # noqa: F811
    got = library.QUERIES[name](spark, SF).toPandas()
    assert len(got) and got.drop(columns=["date"], errors="ignore").notna().any().any()
    if name == "technical_features":
        assert got.groupby("date")["ma_5"].mean().abs().max() < 1e-4
    if name == "fused_portfolio":
        assert np.allclose(got.groupby("date")["weight"].sum(), 1, atol=1e-4)
    if name == "normalised_ic":
        assert got["ic"].abs().max() <= 1


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql_in_steps(spark, duck, name):  # noqa: F811
    got, want = ordered(oracles.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(oracles.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8, atol=2e-6)


def test_memory_scores_meet_group_by_group(spark, monkeypatch):  # noqa: F811
    """Queries of any number are one step of the plan, and groups and tiles change no row."""
    held = library._memory(spark, "/root/testdata/sf0.001")
    odd = held.withColumn("embedding", F.expr("CASE vec_id % 7 WHEN 0 THEN NULL WHEN 1 THEN slice(embedding, 1, 3) WHEN 2 THEN transform(embedding, x -> 0f) ELSE embedding END"))
    odd = odd.withColumn("win_rate", F.expr("CASE WHEN vec_id % 11 = 0 THEN NULL ELSE win_rate END")).withColumn("market_state", F.expr("CASE WHEN vec_id % 5 > 0 THEN market_state END"))
    asked = odd.select(F.explode(F.array("vec_id", F.col("vec_id") + 1000)).alias("query_id"), F.col("embedding").alias("query"), F.col("market_state").alias("now"))
    like = F.coalesce(retrieval.cosine(F.col("embedding"), F.col("query")), F.lit(0.0))
    score = F.round((0.7 * like + 0.3 * memory.state_match("now", "market_state")) * memory.quality(), 6)
    every = odd.filter("CASE WHEN has_val THEN val_ic ELSE ic END >= 0.02").crossJoin(asked).select("query_id", "factor_id", score.alias("score"))
    want = {(r.query_id, r.place): r.score for r in every.withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, factor_id)")).filter("place <= 5").collect()}
    for name, value in (("BLOCK", 40), ("QUERIES", 90), ("TILE", 7)):
        monkeypatch.setattr(memory, name, value)
    found = memory.retrieve(odd, asked)
    assert "Union" not in found._jdf.queryExecution().analyzed().toString()
    assert {(r.query_id, r.place): round(r.score, 6) for r in found.collect()} == pytest.approx(want, abs=2e-6)

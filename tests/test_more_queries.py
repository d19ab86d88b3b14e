"""The dialects, reports and fusion queries against their SQL, against pandas, and on small cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import core, library, ticker
from factorloom.operators import fusion, portfolio
from factorloom.operators import reports as r
from factorloom.plans import dialects, queries, reports
from tests.test_queries import SF, duck, spark  # noqa: F401

ALL = {**dialects.QUERIES, **reports.QUERIES}
SQL = {**dialects.ORACLE_SQL, **reports.ORACLE_SQL}
DAYS = [dt.date(2020, 1, i) for i in range(1, 31)]


def ordered(f: pd.DataFrame) -> pd.DataFrame:
    f = f[sorted(f.columns)].copy()
    if "date" in f:
        f["date"] = pd.to_datetime(f["date"])
    return f.sort_values([k for k in ("factor", "a", "b", "bin", "date", "instrument") if k in f]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = ordered(ALL[name](spark, SF).toPandas()), ordered(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-6)


def _own(spark):  # noqa: F811
    dense = queries.panels.densify(queries.panels.supplier_panel(spark, SF)).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    return dense, dense.groupby("instrument")


def _of(spark, name):  # noqa: F811
    return ALL[name](spark, SF).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)


def test_moments_against_pandas(spark):  # noqa: F811
    dense, own = _own(spark)
    got = _of(spark, "d3_moments")
    rolled = lambda n, f, **k: own["volume"].transform(lambda s: s.rolling(n, **k).apply(f, raw=True)).to_numpy()
    away = lambda v: v - v.mean()
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(got["skew"].to_numpy(float), rolled(6, lambda v: (away(v) ** 3).mean() / (away(v) ** 2).mean() ** 1.5), atol=1e-5)
        np.testing.assert_allclose(got["kurt"].to_numpy(float), rolled(6, lambda v: (away(v) ** 4).mean() / v.var(ddof=1) ** 2 - 3), atol=1e-5)
    d4 = _of(spark, "d4_moments")
    np.testing.assert_allclose(d4["mad"].to_numpy(float), rolled(8, lambda v: np.nanmean(np.abs(v - np.nanmean(v))), min_periods=4), atol=1e-5)
    np.testing.assert_allclose(d4["skew"].to_numpy(float), own["volume"].transform(lambda s: s.rolling(8, min_periods=5).skew()).to_numpy(), atol=1e-5)


def test_recursions_against_pandas(spark):  # noqa: F811
    dense, own = _own(spark)
    got = _of(spark, "d2_recursions")

    def rsi(s):
        d = s.dropna().diff()
        up, down = d.clip(lower=0).ewm(span=14).mean(), (-d).clip(lower=0).ewm(span=14).mean()
        return 100 - 100 / (1 + up / down)

    whole = own.filter(lambda g: g["close"].notna().all())
    for name, g in whole.groupby("instrument"):
        np.testing.assert_allclose(got[got["instrument"] == name]["rsi"].to_numpy(float), rsi(g["close"]).to_numpy(), atol=1e-5)
        np.testing.assert_allclose(got[got["instrument"] == name]["sma"].to_numpy(float), g["close"].ewm(alpha=2 / 6).mean().to_numpy(), atol=1e-5)
    assert len(whole)


def _exposures(spark, cells):  # noqa: F811
    return spark.createDataFrame(cells, "factor string, date date, instrument string, value double, target double")


def test_industry_and_size_against_least_squares(spark):  # noqa: F811
    rng = np.random.default_rng(7)
    n = 40
    cells = pd.DataFrame({"factor": "f", "date": DAYS[0], "instrument": [f"i{k:02}" for k in range(n)], "value": rng.normal(size=n), "industry": rng.choice(["a", "b", "c"], n), "size": rng.lognormal(size=n)})
    x = np.column_stack([np.ones(n), pd.get_dummies(cells["industry"], drop_first=True).to_numpy(float), np.log(cells["size"])])
    want = cells["value"] - x @ np.linalg.lstsq(x, cells["value"], rcond=None)[0]
    got = fusion.industry_size_residual(spark.createDataFrame(cells)).orderBy("instrument").toPandas()["value"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_mean_return_correlation_is_that_of_all_pairs(spark):  # noqa: F811
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(size=(30, 5)) + rng.normal(size=(30, 1)), index=DAYS, columns=list("abcde"))
    wide.iloc[3, 4] = np.nan
    long = wide.stack().rename("ret").rename_axis(["date", "instrument"]).reset_index()
    c = wide.dropna(axis=1).corr().to_numpy()
    got = r.mean_return_correlation(spark.createDataFrame(long)).first()[0]
    np.testing.assert_allclose(got, c[~np.eye(4, dtype=bool)].mean(), atol=1e-9)


def test_shrunk_weights_and_penalty(spark):  # noqa: F811
    f = pd.DataFrame({"factor": list("abc"), "ic": [0.03, -0.02, 0.0], "icir": [0.5, -0.3, 0.1], "val_icir": [0.4, None, 0.2], "n_periods": [60, 80, 50], "debate_score": [8.0, 4.0, 0.0], "tilt": [0.2, 0.0, 0.0]})
    size = np.array([0.4, 0.3, 0.2])
    raw, delta = size**2 / (size**2).sum(), np.clip(1 / (1 + max(0.0, size.var() * 50 - 1)), 0.05, 0.5)
    w = (1 - delta) * raw + delta / 3
    w = 0.2 * np.array([8, 4, 0]) / 12 + 0.8 * w
    w = w * (1 + f["tilt"].to_numpy())
    w /= w.sum()
    got = fusion.shrunk_weights(spark.createDataFrame(f)).orderBy("factor")
    np.testing.assert_allclose(got.toPandas()["weight"], w, atol=1e-9)
    assert [x.sign for x in got.collect()] == [1.0, -1.0, 1.0]
    rho = np.array([[0, 0.5, 0.1], [0.5, 0, 0], [0.1, 0, 0]])
    cut = w / (1 + (rho @ w) / (1 - w))
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1), ("b", "c", 0.0)], "a string, b string, rho double")
    np.testing.assert_allclose(fusion.penalised(got, pairs).orderBy("factor").toPandas()["weight"], cut / cut.sum(), atol=1e-9)


def test_turnover_grid_and_excess(spark):  # noqa: F811
    w = spark.createDataFrame([(DAYS[0], "a", 0.5), (DAYS[0], "b", 0.5), (DAYS[2], "b", 1.0), (DAYS[3], "c", 1.0)], "date date, instrument string, weight double")
    assert [x.turnover for x in portfolio.turnover(w).orderBy("date").collect()] == [0.5, 1.0]
    grid = spark.createDataFrame([(d, i) for d in DAYS[:5] for i in "abc"], "date date, instrument string")
    at = portfolio.on_grid(w, grid).toPandas().pivot(index="date", columns="instrument", values="weight").to_numpy().tolist()
    assert at == [[0.5, 0.5, 0.0], [0.5, 0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]]
    nav = spark.createDataFrame([(DAYS[0], 2.0), (DAYS[1], 3.0), (DAYS[2], 4.0)], "date date, nav double")
    level = spark.createDataFrame([(DAYS[1], 10.0), (DAYS[2], 12.0)], "date date, level double")
    np.testing.assert_allclose(portfolio.excess_nav(nav, level).orderBy("date").toPandas()["excess"], [0.0, 0.5, 0.8])


def test_reports_on_nulls_and_empty_tables(spark):  # noqa: F811
    none = _exposures(spark, [])
    nulls = _exposures(spark, [("f", d, f"i{k}", None if k % 2 else 1.0, None) for d in DAYS[:3] for k in range(4)])
    for cells in (none, nulls):
        for out in (r.ic_matrix(cells), r.paired_ic(cells), r.top_turnover(cells), r.spread_returns(cells, 1), r.factor_pairs(cells)):
            assert out.count() == 0
    assert r.masked_ic(nulls).filter("ic = 0").count() == 3
    assert r.quantile_returns(nulls).filter("mean_return = 0").count() == 5


def test_families_scores_and_tilt(spark):  # noqa: F811
    f = spark.createDataFrame([("a", "m", 0.9), ("b", "m", -0.8), ("c", "m", 0.7), ("d", "v", 0.1)], "factor string, family string, icir double")
    assert [x.factor for x in r.family_balanced(f, 3).collect()] == ["a", "d", "b"]
    assert [x.factor for x in r.family_balanced(f, 9, cap=1).collect()] == ["a", "d"]
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0)], "factor string, round int, score double")
    assert r.weighted_score(s).first().score == pytest.approx(3.0)
    t = spark.createDataFrame([("momentum", "bull", "high"), ("low_volatility", "bear", "high"), ("value", "sideways", "low")], "f string, t string, v string")
    np.testing.assert_allclose([x[0] for x in t.select(fusion.regime_tilt(F.col("f"), F.col("t"), F.col("v"))).collect()], [0.2, 0.35, 0.1])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL) - {"d3_moments", "d4_moments", "d2_recursions"}))
def test_other_queries_run(spark, name):  # noqa: F811
    assert ALL[name](spark, SF).count() > 0


def test_neighbours_of_every_row(spark):
    import numpy as np

    from factorloom.operators import retrieval

    rng = np.random.default_rng(3)
    data = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (-5, [1.0, 1.0, 1.0])]
    memory = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    queries = memory.selectExpr("vec_id AS query_id", "embedding AS query")
    want = {(r.query_id, r.vec_id, r.place) for r in retrieval.nearest(memory, queries, 4).collect()}
    assert len(want) == 43 * 4
    for rows in (7, 2048):
        assert {(r.query_id, r.vec_id, r.place) for r in retrieval.neighbours(memory, 4, rows).collect()} == want
    assert retrieval.neighbours(memory.limit(0), 4).count() == 0


def test_every_row_gets_neighbours(spark):
    from factorloom.plans import queries

    path = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.memory_neighbours(spark, path).collect()}
    assert len(got) == 5 * spark.read.parquet(f"{path}/embeddings.parquet").count()
    assert {r for r in got if r[0] < 5} == {tuple(r) for r in queries.memory_nearest(spark, path).collect()}


def test_recursions_make_each_window_once(spark, monkeypatch):  # noqa: F811
    plan = ALL["d2_recursions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 10 and plan.count("row_number()") <= 2
    monkeypatch.setattr(core, "_FALL", 160.0)  # several blocks of rows
    rng = np.random.default_rng(5)
    close = np.where(rng.random(1300) < 0.15, None, (rng.random(1300) * 100).round(2))
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=i), name, c and c + 1.5, c and c - 1.0, c) for name, shift in (("a", 0), ("b", 7)) for i, c in enumerate(np.roll(close, shift).tolist())]
    dense = spark.createDataFrame(rows, "date date, instrument string, high double, low double, close double")
    got = {(r.date, r.instrument): r for r in dialects.recursions(dense).collect()}
    for r in dense.select("date", "instrument", library.RSI("close").alias("rsi"), library.SMA("close", 6, 2.0).alias("sma"), ticker.atr().alias("atr")).collect():
        for c in ("rsi", "sma", "atr"):
            assert got[r.date, r.instrument][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9))

"""Reports against their SQL and small cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import evaluation, portfolio
from factorloom.plans import evaluations, oracles
from factorloom.sources import panels
from tests.test_library import ordered
from tests.test_queries import SF, duck, spark  # noqa: F401


@pytest.mark.parametrize("name", sorted(evaluations.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got, want = (f.sort_values([*f.columns]).reset_index(drop=True) for f in (ordered(evaluations.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(evaluations.ORACLE_SQL[name]).df())))
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8, atol=2e-6)


@pytest.mark.parametrize("name", ["factor_report", "overfitting", "five_scores", "d3_moments", "d4_moments", "industry_size_residuals", "shrunk_weights", "penalised_weights", "composite_scores", "simple_performance", "risk_managed"])
def test_fusion_and_portfolio_equal_sql(spark, duck, name):  # noqa: F811
    got, want = (f.sort_values([*f.columns]).reset_index(drop=True) for f in (ordered(oracles.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(oracles.ORACLE_SQL[name]).df())))
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8, atol=2e-6)


def managed_by_pandas(weights, caps, flagged, industry, most, least, most_industry, percentile):
    """One date's weights, step by step."""
    held = weights.copy()
    if caps is not None and percentile > 0:
        own = caps[caps.index.isin(held.index)]
        held = held[~held.index.isin(own[own < own.quantile(percentile)].index)]
    held = held[~held.index.isin(flagged)].clip(upper=most)
    held = held[held >= least]
    held = held / held.sum()
    listed = held.index.intersection(industry.index)
    if len(listed):
        held = held[listed]
        total = held.groupby(industry[listed]).sum()
        held = held * industry[listed].map(lambda i: min(1.0, most_industry / total[i]) if i == i and i is not None else 1.0).astype(float)
    return held / held.sum()


def test_risk_manager_against_pandas(spark):  # noqa: F811
    rng = np.random.default_rng(7)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(6)]
    names = [f"n{k:02d}" for k in range(24)]
    weights = {(d, n): float(w) for d in days[:5] for n, w in zip(names, rng.dirichlet(np.ones(24) * 0.7), strict=True)}
    weights |= {(days[5], "lone"): 0.6, (days[5], "none"): 0.4}  # no industry is known of any name of this date
    caps = {k: None if rng.random() < 0.1 else float(rng.integers(1, 9)) for k in weights if rng.random() < 0.9}
    flagged = [k for k in weights if rng.random() < 0.1 and k[0] != days[5]]
    industry = {n: (None if k == 3 else f"i{k % 4}") for k, n in enumerate(names) if k != 5}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = (frame([(*k, w) for k, w in weights.items()], "date date, instrument string, weight double"), frame([(*k, c) for k, c in caps.items()], "date date, instrument string, cap double"), frame(flagged * 2, "date date, instrument string"), frame([*industry.items()], "instrument string, industry string"))
    for limits in ((0.05, 0.001, 0.3, 0.0), (0.2, 0.02, 0.3, 0.25), (1.0, 0.0, 0.1, 0.5)):
        got = {(r.date, r.instrument): r.weight for r in portfolio.risk_managed(*tables, *limits).collect()}
        want = {}
        for d in days:
            of = lambda table, d=d: pd.Series({n: v for (e, n), v in table.items() if e == d}, dtype=float)
            want |= {(d, n): w for n, w in managed_by_pandas(of(weights), of(caps), [n for e, n in flagged if e == d], pd.Series(industry), *limits).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert portfolio.risk_managed(tables[0].limit(0), *tables[1:]).count() == 0
    whole = portfolio.risk_managed(tables[0], most=1.0, least=0.0).groupBy("date").sum("weight").collect()
    assert len(whole) == 6 and all(abs(r[1] - 1) < 1e-12 for r in whole)


def test_families(spark):  # noqa: F811
    cases = {"rank(volume)": "Liquidity", "ts_std(close, 5) * volume": "Liquidity", "TS_MAX(close, 3)": "Volatility", "ts_cov(roe, returns, 20) * -rank(pb)": "Momentum", "ts_zscore(close, 9)": "Mean-reversion", "eps": "Growth", "1 / pe": "Value/Quality", "open": "Value/Quality", "close": "Other", "": "Other", None: "Other"}
    got = spark.createDataFrame([(k,) for k in cases], "text string").select("text", evaluation.family("text").alias("f")).collect()
    assert {r.text: r.f for r in got} == cases


def test_portfolio_report_by_hand(spark):  # noqa: F811
    rng = np.random.default_rng(2)
    r, m = rng.normal(0.001, 0.01, 60), rng.normal(0.0005, 0.01, 60)
    frame = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(zip(r, m, strict=True))], "date date, ret double, market double")
    got = evaluation.portfolio_report(frame).first()
    beta = np.cov(m, r)[0, 1] / (np.var(m) + 1e-8)
    assert abs(got.alpha - (r.mean() - beta * m.mean()) * 252) < 1e-9 and abs(got.annual_return - (np.prod(1 + r) ** (252 / 60) - 1)) < 1e-9 and abs(got.beta - beta) < 1e-9


def test_dense_panels(spark):  # noqa: F811
    rows = [(dt.date(2024, 1, 1), "a", 1.0, 2), (dt.date(2024, 3, 1), "a", 3.0, None), (dt.date(2024, 2, 1), "b", None, 5), (dt.date(2024, 2, 1), "c", 7.0, 7)]
    panel = spark.createDataFrame(rows, "date date, instrument string, close double, volume int")
    got = panels.densify(panel)
    assert got.dtypes == panel.dtypes
    known = {r[:2]: r[2:] for r in rows}
    want = sorted((d, i, *known.get((d, i), (None, None))) for d in {r[0] for r in rows} for i in "abc")
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == want
    assert panels.densify(panel.limit(0)).count() == 0
    assert sorted(map(tuple, panels.densify(panel.select("date", "instrument")).collect())) == [r[:2] for r in want]

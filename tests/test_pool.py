"""Admission to a pool, weights over chosen factors, and weights by momentum steps."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import pool
from factorloom.plans import pools
from tests.test_library import ordered
from tests.test_queries import SF, duck, spark  # noqa: F401


def greedy(singles, pairs, threshold, capacity):
    near = {(a, b) for a, b, r in pairs if r is not None and abs(r) > threshold} | {(b, a) for a, b, r in pairs if r is not None and abs(r) > threshold}
    taken = []
    for f, _ in sorted(singles, key=lambda x: (-abs(x[1] or 0.0), x[0])):
        if len(taken) < capacity and not any((f, t) in near for t in taken):
            taken.append(f)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_admission_is_greedy(spark, seed):  # noqa: F811
    rng = np.random.default_rng(seed)
    n = 25
    singles = [(f"f{i:02d}", None if i == 3 else round(float(rng.normal(0, 0.05)), 2)) for i in range(n)]
    pairs = [(f"f{i:02d}", f"f{j:02d}", None if rng.random() < 0.1 else float(rng.uniform(-1, 1))) for i in range(n) for j in range(i) if rng.random() < 0.5]
    got = pool.admitted(spark.createDataFrame(singles, "factor string, ic double"), spark.createDataFrame(pairs, "a string, b string, rho double"), 0.5, 6)
    assert [r.factor for r in sorted(got.collect(), key=lambda r: r.place)] == greedy(singles, pairs, 0.5, 6)


def test_admission_without_factors(spark):  # noqa: F811
    none = pool.admitted(spark.createDataFrame([], "factor string, ic double"), spark.createDataFrame([], "a string, b string, rho double"), 0.5, 3)
    assert none.count() == 0


def test_admission_equals_sql(spark, duck):  # noqa: F811
    got, want = ordered(pools.pool_admission(spark, SF).toPandas()), ordered(duck.sql(pools.ORACLE_SQL["pool_admission"]).df())
    assert len(got) > 1
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_weights_of_chosen_factors(spark):  # noqa: F811
    rng = np.random.default_rng(4)
    names, days = ["a", "b", "c", "d"], [dt.date(2021, 1, 1) + dt.timedelta(k) for k in range(14)]
    rows = []
    for d in days:
        for i in range(9):
            x = rng.normal(size=4)
            y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal() * 0.1
            rows.append((d, f"i{i}", *[None if rng.random() < 0.2 else float(v) for v in x], None if rng.random() < 0.1 else float(y)))
    wide = spark.createDataFrame(rows, "date date, instrument string, a double, b double, c double, d double, target double")
    chosen = [(d, f) for k, d in enumerate(days) for f in names if (k + names.index(f)) % 3] + [(days[5], "unknown"), (days[0], "a")]
    got = {r.date: r for r in pool.chosen_weights(wide, names, spark.createDataFrame(chosen, "date date, factor string"), embargo=2, window=6).collect()}
    frame = pd.DataFrame(rows, columns=["date", "instrument", *names, "target"])
    assert set(got) == {d for d, _ in chosen}
    for k, d in enumerate(days):
        mine = sorted({f for x, f in chosen if x == d} & set(names))
        past = frame[frame.date.isin(days[max(0, k - 6) : max(0, k - 2)])].dropna(subset=[*mine, "target"])
        assert got[d].n == len(past) and got[d].names == mine
        if len(past) < 10:
            assert got[d].weights is None and got[d].intercept is None
        else:
            want = np.linalg.lstsq(np.column_stack([past[mine], np.ones(len(past))]), past.target, rcond=None)[0]
            np.testing.assert_allclose([*got[d].weights, got[d].intercept], want, rtol=1e-7, atol=1e-9)
    weights = spark.createDataFrame([(r.date, r.n, r.names, r.weights, r.intercept) for r in got.values()], "date date, n long, names array<string>, weights array<double>, intercept double")
    for r in pool.chosen_scores(wide, weights, names).collect():
        w, cell = got[r.date], frame[(frame.date == r.date) & (frame.instrument == r.instrument)].iloc[0]
        want = 0.0 if w.weights is None else w.intercept + sum((0.0 if pd.isna(cell[f]) else cell[f]) * x for f, x in zip(w.names, w.weights, strict=True))
        assert abs(r.score - want) < 1e-9


def test_momentum_steps_reach_the_least_loss():
    rng = np.random.default_rng(6)
    names = [f"f{i}" for i in range(6)]
    m = np.corrcoef(rng.normal(size=(6, 40)))
    c = rng.normal(0, 0.2, 6)
    single, mutual = dict(zip(names, c.tolist(), strict=True)), {(names[i], names[j]): float(m[i, j]) for i in range(6) for j in range(i)}
    w = np.zeros(6)
    for _ in range(4000):  # coordinate descent
        for i in range(6):
            rest = c[i] - m[i] @ w + m[i, i] * w[i]
            w[i] = np.sign(rest) * max(abs(rest) - 5e-3 / 2, 0) / m[i, i]
    loss = lambda x: x @ m @ x - 2 * x @ c + 5e-3 * np.abs(x).sum()
    got = pool.adam_weights(single, mutual)
    mine = np.array([got[f] for f in names])
    assert loss(mine) - loss(w) < 1e-4 and np.abs(mine - w).max() < 0.02
    assert pool.adam_weights({}, {}) == {} and abs(pool.adam_weights({"x": 0.3}, {})["x"] - 0.2975) < 0.01

"""Whitening against exact sums and a dense eigenvalue problem."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from factorloom.llm import queries, whitening


def brute(vectors):
    """n, deviations, eigenvalues, eigenvectors (columns) of the integer vectors, with the sums in Python's integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    d = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(d.T @ d / n)
    return n, deviation, d, e[::-1], v[:, ::-1]


def check(got, vectors, ids, k):
    n, deviation, d, e, v = brute(vectors)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    for c in range(1, k + 1):
        mine = {r.vec_id: r for r in got if r.component == c}
        want = d @ v[:, c - 1] / math.sqrt(e[c - 1])
        w = np.array([mine[i].whitened for i in ids])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-8
        assert [mine[i].deviation for i in ids] == deviation
        assert all(r.n == n and abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine.values())


@pytest.mark.parametrize(("rows", "dim"), [(300, 12), (40, 3), (9, 8)])
def test_components_and_coordinates(spark, rows, dim, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "BRANCHES", 2)
    rng = np.random.default_rng(rows)
    x = (rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim)) + 50).tolist()
    df = spark.createDataFrame([*enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    check(whitening.whiten(df).collect(), x, range(rows), min(dim, 8))


def test_odd_rows(spark):
    x = np.random.default_rng(3).normal(size=(20, 4)).tolist()
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0, 3.0], 1), (103, [math.nan, 1.0, 1.0, 1.0], 1), (104, [math.inf] * 4, 1), (105, [1.0, 2.0], 1), (None, x[0], 1)]
    df = spark.createDataFrame([(i, v, 5) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(df).collect()
    check([_named(r) for r in got], [*x, x[0]], range(21), 4)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id in (100, 101, 103)")).count() == 0


def _named(r):
    class Row:
        pass

    out = Row()
    out.__dict__ = r.asDict() | {"vec_id": 20 if r.vec_id is None else r.vec_id}
    return out


def test_without_spread(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(30)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is not None) == (r.component == 1) and r.identity_error < 1e-9 for r in flat)
    assert all(abs(r.explained - (r.component == 1)) < 1e-9 for r in flat)


def test_large_entries(spark):
    rows = [(0, [1e12, 1.0]), (1, [-1e12, 2.0]), (2, [3e15, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, deviation, _, _, _ = brute([v for _, v in rows])
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got)


def test_query_whitens_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    kept = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [r.embedding for r in kept], [r.vec_id for r in kept], 8)

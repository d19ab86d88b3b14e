"""The vector index against the comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from factorloom.operators import retrieval, vector_index
from tests.test_queries import spark  # noqa: F401

KIND = "vec_id long, embedding array<double>"


def found(df):
    return sorted((r.query_id, r.place, r.vec_id, r.similarity) for r in df.collect())


def clustered(n=900, groups=12, dim=8):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(groups, dim)) * 5
    return [(i, (centres[i % groups] + rng.normal(size=dim) * 0.1).tolist()) for i in range(n)]


def test_same_rows_with_few_comparisons(spark):  # noqa: F811
    df = spark.createDataFrame(clustered(), KIND)
    pairs = spark.sparkContext.accumulator(0)
    assert found(vector_index.neighbours(df, 3)) == found(vector_index.neighbours(df, 3, centres=30, pairs=pairs))
    assert found(vector_index.neighbours(df, 3, centres=30)) == found(retrieval.neighbours(df, 3))
    assert 0 < pairs.value < 0.2 * 900 * 900


@pytest.mark.parametrize("k", [1, 4])
def test_odd_vectors_copies_and_ties(spark, monkeypatch, k):  # noqa: F811
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    monkeypatch.setattr(vector_index, "QUERIES", 5)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(30)] + [(200 + i, [2.0, 4.0, 6.0]) for i in range(3)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, 2.0]), (304, [2.0, 1.0]), (-5, None), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert found(vector_index.neighbours(df, k)) == found(retrieval.neighbours(df, k))


def test_without_clusters_and_without_rows(spark):  # noqa: F811
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(120)], KIND)
    assert found(vector_index.neighbours(df, 2, centres=5)) == found(retrieval.neighbours(df, 2))
    assert found(vector_index.neighbours(df.limit(0), 2)) == []
    assert found(vector_index.neighbours(df.limit(1), 2)) == []


def test_no_table_of_queries_by_cells(spark):  # noqa: F811
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(300)], KIND)
    index = vector_index.VectorIndex(df, 3, centres=40)
    assert index.nearest_classes().count() == 3 * 300
    assert max(spark.read.parquet(p).count() for p in index.stages.held) <= 3 * 300


def test_tiles_groups_and_ties_across_them(spark, monkeypatch):  # noqa: F811
    for name, value in (("BLOCK", 60), ("QUERIES", 16), ("TILE", 9)):
        monkeypatch.setattr(vector_index, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(150)] + [(500 + i, [1.0 + i, 2.0 + 2 * i, 0.0]) for i in range(40)] + [(600 + i, rng.normal(size=5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    assert vector_index.VectorIndex(df, 4, centres=6).groups > 2
    assert found(vector_index.neighbours(df, 3, centres=6)) == found(retrieval.neighbours(df, 3))

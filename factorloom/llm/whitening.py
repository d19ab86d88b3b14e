"""Whitening of embeddings by a tall-and-skinny QR; the covariance of the vectors is never formed.

Rows are centred by exact sums of integers. Each partition folds its rows into
one triangular factor; factors are merged eight at a time, a tree of tasks, and
the right singular vectors of the last one are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, stored

COMPONENTS, STEP, SHIFT = 8, 1024, 100_000
#: Rows that are folded into a factor at once, and factors merged by one task.
ROWS, BRANCHES = 4096, 8
#: Integers whose size is below this are handled as 64-bit ones, larger ones as Python's.
SAFE = 1 << 62


def vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and the vector as doubles, under the names vec_id and v."""
    return embeddings.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and integer rows of the whole vectors of a batch, a matrix for each length."""
    v = batch.column("v")
    sizes, values = v.value_lengths().to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(float)
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = sizes > 0
    whole[of[~np.isfinite(values)]] = False
    x = np.floor(np.clip(np.where(np.isfinite(values), values, 0) * STEP, -(2.0**61), 2.0**61)).astype(np.int64) + SHIFT
    for dim in np.unique(sizes[whole]):
        rows = whole & (sizes == dim)
        yield batch.column("vec_id").filter(pa.array(rows)), x[rows[of]].reshape(-1, dim)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(x) * int(np.abs(x).max()) < SAFE:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where they hold it, else Python's."""
    if n * int(np.abs(x).max()) < SAFE and max(map(abs, sums)) < SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of the vectors and the sum of each of their dimensions; vectors of another length than most (of lengths equally common the largest) don't count.

    What comes to the driver is one row for each dimension.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for _, x in _matrices(b):
                n, old = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = n + len(x), [a + t for a, t in zip(old, _total(x), strict=True)]
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "pos": [*range(dim)], "n": [n] * dim, "total": pa.array([str(s) for s in sums])})

    partial = rows.mapInArrow(part, "dim long, pos long, n long, total string")
    sums = stored(partial.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "sums")
    most = sums.filter("pos = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return 0, []
    found = sums.filter(F.col("dim") == most.dim).orderBy("pos").collect()
    return most.n, [int(r.total) for r in found]


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factors(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """node, r: the triangular factor of each partition's centred rows."""
    dim = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, waiting, held = np.zeros((0, dim)), [], 0
        for b in batches:
            for _, x in _matrices(b):
                if x.shape[1] == dim:
                    for i in range(0, len(x), ROWS):
                        waiting.append(_centred(x[i : i + ROWS], n, sums).astype(float) / n)
                        held += len(waiting[-1])
                        if held >= ROWS:
                            r, waiting, held = _r(np.vstack([r, *waiting])), [], 0
        if held or len(r):
            yield _node(TaskContext.get().partitionId(), _r(np.vstack([r, *waiting])))

    return rows.mapInArrow(fold, "node long, r binary")


def _node(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})


def merged(factors: DataFrame, dim: int, nodes: int) -> DataFrame:
    """The factor of all rows, by rounds in which a task merges up to BRANCHES factors."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        parts = [np.frombuffer(r, float).reshape(-1, dim) for r in table.column("r").to_pylist()]
        return pa.Table.from_batches([_node(table.column("parent")[0].as_py(), _r(np.vstack(parts)))])

    while nodes > 1:
        factors = factors.withColumn("parent", F.floor(F.col("node") / BRANCHES)).groupBy("parent").applyInArrow(merge, "node long, r binary")
        nodes = -(-nodes // BRANCHES)
    return factors


def components(rows: DataFrame, n: int, sums: list[int], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The unit eigenvectors (rows) with the largest eigenvalues, these, and the sum of all eigenvalues."""
    dim = len(sums)

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column("r").to_pylist():
                _, s, v = np.linalg.svd(np.vstack([np.frombuffer(r, float).reshape(-1, dim), np.zeros((dim, dim))])[: 2 * dim], full_matrices=False)
                v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1, 1)
                k = min(most, dim)
                yield pa.RecordBatch.from_pydict({"component": pa.array(range(k), pa.int32()), "s": s[:k].tolist(), "trace": [float((s * s).sum())] * k, "v": v[:k].tolist()})

    with Scratch(rows.sparkSession, "factors") as scratch:
        first = scratch.store(factors(rows, n, sums), "factors")
        nodes = first.agg(F.max("node")).first()[0] + 1
        found = merged(first, dim, nodes).mapInArrow(decompose, "component int, s double, trace double, v array<double>").orderBy("component").collect()
    s, trace = np.array([r.s for r in found]), found[0].trace
    return np.array([r.v for r in found]), s * s / n, trace / n


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each whole vector and component.

    Left out are vectors that are null or empty, that hold null or non-finite
    entries, and those of another length than most vectors have. Repeated vectors
    and ids count as often as they stand. A component whose eigenvalue is 0 up to
    rounding (as all of a single vector's) has no direction: whitened is null, and
    explained is 0, or null where all are 0; identity_error goes over the others,
    null if there is none. deviation is null where it doesn't fit in 64 bits.
    Entries beyond 2^51 count as 2^51. No whole vector: no rows.
    """
    rows = vectors(embeddings, vector, key)
    spark, kind = rows.sparkSession, dict(rows.dtypes)["vec_id"]
    n, sums = exact_sums(rows)
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    v, e, trace = components(rows, n, sums, most)
    dim, k = len(sums), len(e)
    real = np.sqrt(e) > np.sqrt(e[0]) * dim * 16 * np.finfo(float).eps
    turn = (v[real] / np.sqrt(e[real])[:, None]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in _matrices(b):
                if x.shape[1] != dim:
                    continue
                d = _centred(x, n, sums)
                far = d if d.dtype != object and float(np.abs(d).max()) ** 2 * dim < SAFE else d.astype(object)
                deviation = [y if y < 1 << 63 else None for y in (far * far).sum(1).tolist()]
                w = (d.astype(float) / n) @ turn
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    placed = stored(rows.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    at = [F.col("w")[i] for i in range(int(real.sum()))]
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    seen = placed.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else ()
    error = max((abs(c - (i == j)) for c, (i, j) in zip(seen, pairs, strict=True)), default=None)
    told = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.col("w")[int(real[:i].sum())] if real[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(float(e[i] / trace) if trace else None).cast("double").alias("explained")) for i in range(k)])
    return placed.select("vec_id", "deviation", F.explode(told).alias("c")).select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))

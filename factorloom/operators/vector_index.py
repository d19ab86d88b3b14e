"""An index of vectors that finds exact nearest neighbours by their angle without comparing all pairs.

Equal vectors are one class, however many rows hold them. Classes are put into the
cell of the nearest of some centres; a cell knows the smallest and the largest
angle of its classes to its centre, so for a query at a known angle to the centre
no class in it can be nearer than the difference. Runs of cells are groups. A query
is first compared within its own group, its own cell before the others; then it
goes to the groups, and there to the cells, that may still hold something as near
as the worst that it would keep. A pair of groups is one task, which compares tiles
in single precision and the pairs that may count in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.stages import Stages

#: Centres are at most so many sampled vectors, about the square root of the number of classes.
CENTRES = 1024
#: Fewest classes that are dealt to more than one group, most classes of a group, and groups that smaller tables are dealt to.
BLOCK, GROUP, GROUPS = 2048, 32768, 8
#: Queries and classes of a cell to a tile of comparisons.
QUERIES, TILE = 4096, 2048
#: What rounding of similarities to 6 digits may hide.
_SLACK = 2e-6


class VectorIndex:
    """Classes of equal vectors (vec_id, embedding) in cells; `most` ids of each class are kept, the smallest, which is enough for up to most - 1 neighbours.

    Rows without vec_id are left out. Vectors that are null or empty, or hold
    nulls, zeros alone or what is not finite, have no direction. The centres, at
    most CENTRES vectors chosen by a hash, and the figures of their cells are held
    by the driver; nothing else is.
    """

    def __init__(self, memory: DataFrame, most: int, centres: int | None = None):
        spark = memory.sparkSession
        self.stages, self.most, self.spark = Stages(spark, "vectors"), most, spark
        self.rows = self.stages.store(memory.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")))
        salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, most)
        parts = self.rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
        classes = parts.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("cid", F.col("ids")[0])
        classes = self.stages.store(classes.filter("v is not null").mapInArrow(_units, "cid long, v array<double>, ids array<long>, u array<double>"))
        directed = classes.filter("u is not null")
        n = directed.count()
        wanted = centres or (1 if n <= BLOCK else min(CENTRES, math.ceil(math.sqrt(n))))  # what fits into one block is compared whole
        sample = [r.u for r in directed.orderBy(F.xxhash64("cid"), "cid").limit(wanted).select("u").collect()]
        self.centres = {size: np.array([u for u in sample if len(u) == size]) for size in {len(u) for u in sample}}
        self.first = {size: sum(len(c) for s, c in self.centres.items() if s < size) for size in self.centres}  # number of a length's first cell
        assign = _assigner(self.centres, self.first)
        placed = self.stages.store(directed.mapInArrow(assign, "cid long, v array<double>, ids array<long>, u array<double>, cell long, angle double"))
        figures = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer")).orderBy("cell").collect()
        # The groups are runs of about equal length of the classes by cell; a large cell lies in several.
        width, start, places = -(-n // max(-(-n // GROUP), min(GROUPS, -(-n // BLOCK)), 1)), 0, []
        self.cells: dict[int, tuple[float, float, int, int]] = {}  # smallest and largest angle, first and last group
        for r in figures:
            inner, outer = (r.inner, r.outer) if r.cell >= 0 else (0.0, math.pi)
            self.cells[r.cell] = (inner, outer, start // width, (start + r.n - 1) // width)
            places += [F.lit(r.cell), F.struct(F.lit(start).cast("long").alias("start"), F.lit(r.n).cast("long").alias("n"))]
            start += r.n
        self.groups = -(-start // width) if start else 0
        at = F.create_map(*places)[F.col("cell")] if places else F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("n"))
        self.classes = self.stages.store(placed.withColumn("group", F.floor((at["start"] + F.pmod(F.xxhash64("cid"), at["n"])) / F.lit(max(width, 1))).cast("int")))

    def _visits(self, queries: DataFrame) -> DataFrame:
        """cid, u, cell, worst, group and `to`: each query for the other groups that may hold something as near as `worst`."""
        bound, cells, groups = _bounds(self.centres, self.first, self.cells), self.cells, self.groups

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                worst = b.column("worst").fill_null(-math.inf).to_numpy(zero_copy_only=False)
                own = b.column("group").to_numpy()
                wanted = np.zeros((len(worst), groups), bool)
                for _, rows, u in _by_length(b.column("u")):
                    near, names = bound(u)
                    open_ = near >= (worst[rows] - _SLACK)[:, None]
                    for c, name in enumerate(names):
                        _, _, low, high = cells[name]
                        wanted[rows, low : high + 1] |= open_[:, c, None]
                wanted[np.arange(len(own)), own] = False
                row, to = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([*b.select(["cid", "u", "cell", "worst", "group"]).take(pa.array(row)).columns, pa.array(to, pa.int32())], ["cid", "u", "cell", "worst", "group", "to"])

        return queries.select("cid", "u", "cell", "worst", "group").mapInArrow(visit, "cid long, u array<double>, cell long, worst double, group int, to int")

    def _compared(self, asked: DataFrame, held: DataFrame, pairs: Accumulator | None) -> DataFrame:
        """cid, other, similarity: for each query (cid, u, cell, worst, group, to) the `most` best classes of the group `to`, where they are as near as `worst`."""
        most, bound = self.most, _bounds(self.centres, self.first, self.cells)

        def best(key: tuple, q: pa.Table, m: pa.Table) -> pa.Table:
            inside, found = key[0].as_py() == key[1].as_py(), []
            ids, cells = m["cid"].to_numpy(), m["cell"].to_numpy()
            held = {size: (rows, x) for size, rows, x in _by_length(m["u"].combine_chunks())} if len(m) else {}
            asked, own = q["cid"].to_numpy(), q["cell"].to_numpy()
            worst = q["worst"].combine_chunks().fill_null(-math.inf).to_numpy(zero_copy_only=False) if len(q) else None
            for size, rows, u in _by_length(q["u"].combine_chunks()) if len(q) else ():
                if size in held:
                    of, x = held[size]
                    by = np.argsort(own[rows], kind="stable")
                    rows, u = rows[by], u[by]
                    for a in range(0, len(rows), QUERIES):
                        part = slice(a, a + QUERIES)
                        row, other, score, n = _nearest(u[part], own[rows[part]], worst[rows[part]], x, ids[of], cells[of], bound, inside, most)
                        found.append((asked[rows[part]][row], other, score))
                        if pairs is not None:
                            pairs.add(n)
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], t) for t in (np.int64, np.int64, float)]
            return pa.table(dict(zip(("cid", "other", "similarity"), columns, strict=True)))

        return self.stages.store(asked.groupBy("group", "to").cogroup(held.groupBy("from", "group")).applyInArrow(best, "cid long, other long, similarity double"))

    def _kept(self, found: DataFrame) -> DataFrame:
        by = Window.partitionBy("cid").orderBy(F.desc("similarity"), "other")
        return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= self.most)

    def nearest_classes(self, pairs: Accumulator | None = None) -> DataFrame:
        """cid, other, similarity: for each class the `most` classes nearest to it, itself among them; ties by the smallest id."""
        none, held = F.lit(None).cast("double"), self.classes.select("cid", "u", "cell", "group")
        first = self._compared(held.select("cid", "u", "cell", none.alias("worst"), "group", F.col("group").alias("to")), held.withColumn("from", F.col("group")), pairs)
        if self.groups <= 1:  # all of them were looked into
            return first
        worst = first.groupBy("cid").agg(F.count("*").alias("n"), F.min("similarity").alias("worst")).filter(F.col("n") == self.most)
        visits = self._visits(held.join(worst, "cid", "left"))
        by_pair = held.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))).filter(F.col("from") != F.col("group"))
        later = self._compared(visits, by_pair, pairs)
        return self._kept(first.union(later)).select("cid", "other", "similarity")


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of vectors, the rows that have it and their matrix; -1 and no columns for null."""
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        own = vectors if len(rows) == len(sizes) else vectors.take(pa.array(rows))
        yield size, rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), max(size, 0))


def _bounds(centres: dict[int, np.ndarray], first: dict[int, int], cells: dict[int, tuple]) -> Callable[[np.ndarray], tuple[np.ndarray, list[int]]]:
    """A function that gives for vectors of one length the largest similarity that anything in a cell can have to each, and the cells' names."""

    def bound(u: np.ndarray) -> tuple[np.ndarray, list[int]]:
        size = u.shape[1]
        if size not in centres:
            return np.ones((len(u), 1)), [-1]
        names = [c for i in range(len(centres[size])) if (c := first[size] + i) in cells]
        angle = np.arccos(np.clip(u @ centres[size][[c - first[size] for c in names]].T, -1, 1))
        inner, outer = (np.array([cells[c][i] for c in names]) for i in (0, 1))
        return np.cos(np.maximum(0.0, np.maximum(angle - outer, inner - angle))), names

    return bound


def _nearest(u: np.ndarray, own: np.ndarray, worst: np.ndarray, x: np.ndarray, ids: np.ndarray, cells: np.ndarray, bound: Callable, inside: bool, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of u, ids, similarities: the `most` classes of x nearest to each of u, where they are as near as `worst`; and the number of comparisons.

    Cells are looked into as long as they may hold something as near as the worst
    that a row would keep; `inside` the group its own cell comes first.
    """
    by = np.lexsort((ids, cells))
    x, ids, cells = x[by], ids[by], cells[by]
    names, starts = np.unique(cells, return_index=True)
    ends = np.append(starts[1:], len(cells))
    near, known = bound(u)
    near = near[:, [known.index(c) for c in names.tolist()]]
    single_u, single_x = u.astype(np.float32), x.astype(np.float32)
    loose = 1e-6 + 1e-7 * (u.shape[1] + 4)  # what single precision and rounding may hide
    least, compared = worst.copy(), 0
    score, other = np.full((len(u), most), -math.inf), np.full((len(u), most), np.iinfo(np.int64).max)
    for now in (True, False) if inside else (False,):
        for c, name in enumerate(names):
            wanted = own == name if now else near[:, c] >= least - _SLACK
            if inside and not now:
                wanted &= own != name
            for a in range(starts[c], ends[c], TILE):
                rows = np.flatnonzero(wanted)
                if not len(rows):
                    break
                tile = single_u[rows] @ single_x[a : min(a + TILE, ends[c])].T
                compared += tile.size
                edge = least[rows] - loose
                fresh = np.flatnonzero(edge == -math.inf)
                if len(fresh) and tile.shape[1] > most:
                    edge[fresh] = np.partition(tile[fresh], -most, axis=1)[:, -most] - 2 * loose
                at = np.flatnonzero(tile >= edge.astype(np.float32)[:, None])
                if not len(at):
                    continue
                i, j = np.divmod(at, tile.shape[1])
                row, to = rows[i], a + j
                exact = np.round(np.einsum("ij,ij->i", u[row], x[to]), 6)
                kept = exact >= least[row]
                row, to, exact = row[kept], to[kept], exact[kept]
                some = np.unique(row)
                all_row = np.concatenate([row, np.repeat(some, most)])
                all_id, all_score = np.concatenate([ids[to], other[some].ravel()]), np.concatenate([exact, score[some].ravel()])
                order = np.lexsort((all_id, -all_score, all_row))
                _, begin = np.unique(all_row[order], return_index=True)
                top = order[begin[:, None] + np.arange(most)]
                other[some], score[some] = all_id[top], all_score[top]
                least[some] = np.maximum(least[some], score[some, -1])
    row, place = np.nonzero(score > -math.inf)
    return row, other[row, place], score[row, place], compared


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = []
        for v in b.column("v").to_pylist():
            x = np.array([math.nan if c is None else c for c in v], float)
            norm = math.sqrt(x @ x)
            units.append((x / norm).tolist() if norm and math.isfinite(norm) else None)
        yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("v"), b.column("ids"), pa.array(units, pa.list_(pa.float64()))], ["cid", "v", "ids", "u"])


def _assigner(centres: dict[int, np.ndarray], first: dict[int, int]):
    """Adds to classes the cell of the nearest centre of their length, -1 where there is none, and the angle to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.full(len(b), -1), np.zeros(len(b))
            for size, rows, u in _by_length(b.column("u")):
                if size in centres:
                    cos = u @ centres[size].T
                    cell[rows] = first[size] + cos.argmax(axis=1)
                    angle[rows] = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(angle, pa.float64())], [*b.schema.names, "cell", "angle"])

    return assign


def neighbours(memory: DataFrame, k: int, centres: int | None = None, pairs: Accumulator | None = None) -> DataFrame:
    """query_id, vec_id, similarity, place: the k stored vectors most like each stored vector, rounded to 6 digits, ties by vec_id.

    The rows are those of a comparison of all pairs. Vectors without a similarity
    (to a query: without direction, or of another length) come last, by vec_id.
    vec_id is a key. Where vectors lie in no clusters, bounds leave nothing out and
    all classes are compared in tiles, a time that grows with the square of their
    number; `pairs` counts the comparisons of classes.
    """
    index = VectorIndex(memory, k + 1, centres)
    near = index.nearest_classes(pairs)
    ids = index.classes.select(F.col("cid").alias("other"), "ids")
    listed = near.join(ids, "other").select("cid", F.explode("ids").alias("vec_id"), "similarity")
    by = Window.partitionBy("cid").orderBy(F.desc("similarity"), "vec_id")
    best = listed.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1)
    best = index.stages.store(best.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "similarity"))).alias("found")))
    rows = index.rows.join(index.classes.select("v", "cid"), "v", "left").select("vec_id", "cid").join(best, "cid", "left")
    fill = [r.vec_id for r in index.rows.orderBy("vec_id").limit(2 * k + 2).select("vec_id").collect()]
    others = F.array(*map(F.lit, fill)).cast("array<long>")
    pair = lambda i, s: F.struct(i.alias("vec_id"), s.alias("similarity"))
    none = F.lit(None).cast("double")
    found = F.coalesce(F.transform("found", lambda x: pair(x["vec_id"], x["similarity"])), F.array().cast("array<struct<vec_id:long,similarity:double>>"))
    own = F.filter(found, lambda x: x["vec_id"] != F.col("vec_id"))
    rest = F.filter(others, lambda i: (i != F.col("vec_id")) & ~F.exists(own, lambda x: x["vec_id"] == i))
    whole = F.slice(F.concat(own, F.transform(rest, lambda i: pair(i, none))), 1, k)
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(whole).alias("at", "x")).select("query_id", "x.vec_id", "x.similarity", (F.col("at") + 1).cast("int").alias("place"))

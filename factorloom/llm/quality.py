"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_ids, stored, texts
from factorloom.llm.tokens import small_parts

#: Bound of the labelled rows that a fit uses; more labels are thinned by a hash of doc_id.
MAX_TRAIN_ROWS = 200_000
N_FEATURES, RIDGE, SEED = 384, 1e-3, 11
#: Documents with a lower score are rejected.
THRESHOLD = 0.3

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "stop": b".", "comma": b",", "shout": b"!", "bar": b"|", "sign": b"#$%&*", "other": b"\"'()+-/:;<=>?@[\\]^_`{}~"}
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _k] = 1
_TABLE[128:, len(_CLASSES)] = 1


def statistics(text: str) -> list[float]:
    """Numbers between about 0 and 3 that describe a text: shares of kinds of bytes, lengths, and repetition of words and lines."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(b, minlength=256) @ _TABLE / max(len(b), 1)
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    n, firsts = len(words), Counter(x for x in lines if x)
    n_lines = sum(firsts.values())
    capital = sum(w.isupper() for w in counts) / max(len(counts), 1)
    return [
        *(np.sqrt(shares) * 2).tolist(), np.log1p(len(b)) / 8, np.log1p(n) / 6, len(text) / max(n, 1) / 8, len(counts) / max(n, 1),
        np.log1p(len(counts)) / max(np.log1p(n), 0.5), max(counts.values(), default=0) / max(n, 1), sum(map(eq, words, words[1:])) / max(n, 1), len(firsts) / max(n_lines, 1),
        max(firsts.values(), default=0) / max(n_lines, 1), np.log1p(n_lines) / 4, np.log1p(len(b) / max(n_lines, 1)) / 6, capital,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text; null counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches):
            rows = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs).mapInArrow(measure, "doc_id long, x array<double>")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@dataclass
class Classifier:
    """What scoring needs: the scaling, the random projection, the weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray
    chances: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance, with a small share of the raw value, which orders documents within a level of the curve."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.levels, self.chances) + 0.01 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield np.array(b.column("x").to_pylist(), float), b.column("label").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """The arrays that `sums` gives for each partition's (x, labels), added up; their number is that of the partitions of a bounded sample."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y in _matrix(batches):
            s = sums(x, y)
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return sum(np.frombuffer(r.total) for r in rows.mapInArrow(add, "total binary").toLocalIterator())


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Classifier | None:
    """A classifier from the labelled rows outside fold 0, at most about `max_rows` of them; None if they lack a label of either kind.

    Folds 2 to 4 give the weights by normal equations that are summed within
    partitions; fold 1 gives the calibration curve.
    """
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    train = measured.join(marks.filter(fold() != 0), "doc_id").select("x", "label", (fold() == 1).alias("curve"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h"))
    known = stored(train, "train")
    n, positive = known.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        return None
    chosen = known.filter(F.col("h") < int((1 << 20) * min(1, max_rows / n))).coalesce(16)
    body, curve = chosen.filter(~F.col("curve")), chosen.filter("curve")
    k = len(known.select("x").first().x)
    moments = _summed(chosen, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    mean = moments[1 : k + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[k + 1 :] / moments[0] - mean**2, 1e-6))
    rng = np.random.default_rng(SEED)
    model = Classifier(mean, scale, rng.normal(0, 1 / np.sqrt(2 * k), (k, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES), np.zeros(N_FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(z)]])

    total = _summed(body, normal)
    m = N_FEATURES + 1
    if not np.ndim(total) or total[-1] < 2:
        return None
    model.weights = np.linalg.solve(total[: m * m].reshape(m, m) + RIDGE * total[-1] / N_FEATURES * np.eye(m), total[m * m : m * m + m])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _matrix(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), pa.array(y)], ["raw", "label"])

    rated = VectorAssembler(inputCols=["raw"], outputCol="features").transform(curve.mapInArrow(rate, "raw double, label double"))
    if rated.isEmpty():
        model.levels, model.chances = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    steps = IsotonicRegression(featuresCol="features", labelCol="label").fit(rated)
    model.levels, model.chances = np.array(steps.boundaries.toArray()), np.clip(steps.predictions.toArray(), 0, 1)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document doc_id, held_out, score and predicted.

    Empty and null texts are scored like others. Without labels of both kinds
    every score is 0.5. Rows repeated with their doc_id are scored each time; a row
    without doc_id has no label and is not held out. An empty table gives no rows;
    columns beyond doc_id, text and quality are not read.
    """
    measured = stored(document_statistics(docs), "statistics")
    model = fit(measured, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float)
            s = np.full(b.num_rows, 0.5) if model is None or not len(x) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(s, 0, 1))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all their columns kept.

    Only the ids of documents that go are brought to the texts. Rows without
    doc_id stay; of rows that share one all go if one is rejected. Without labels
    of both kinds, and in an empty table, nothing goes.
    """
    bad = stored(quality_scores(docs, labels).filter("predicted = 0 and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(small_ids(bad), "doc_id", "left_anti").select(docs.columns)

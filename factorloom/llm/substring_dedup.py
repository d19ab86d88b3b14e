"""Removal of repeated byte strings across documents.

A byte goes when a string of 100 bytes that covers it also starts earlier. Every
string of that length elects one of the 40-byte grams in it, its anchor, by the
smallest hash; equal strings elect the same gram at the same place. The strings
that elect one gram start in a run and make one segment of text, so

1. segments are compared whole, by hash: of equal ones the earliest stays and
   all strings of the others are repeats;
2. only where different segments share an anchor, as at the edges of a repeated
   passage, the strings in their earliest occurrences are compared one by one;
3. what both find is laid over each document.

The construction of one suffix array over all documents, symbol by symbol, takes
as many passes over everything as the longest document has bytes; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import keyed, named, stored, texts
from factorloom.llm.minhash import mix
from factorloom.llm.tokens import small_parts

LENGTH, GRAM = 100, 40
#: Strings that are looked at together; longer documents are taken in parts.
_PART = 1 << 19
#: Slices of the strings' hashes that are compared one after the other, each with a fraction of the shuffle files.
SLICES = 4
_STEP, _ODD = np.array([0x9E3779B97F4A7C15], np.uint64), np.array([0xD6E8FEB86659FD93], np.uint64)


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of b on, as one number."""
    words = np.lib.stride_tricks.as_strided(b, (len(b) - 7, 8), (1, 1))
    return np.ascontiguousarray(words).view("<u8")[:, 0]


def string_hashes(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash, unlike that of grams, of the LENGTH bytes from each place in `at` on."""
    words, h = _words(b), np.zeros(len(at), np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h = (h + words[at + k]) * _ODD
        h ^= h >> np.uint64(32)
    return mix(h ^ _ODD)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes of b."""
    n = len(b) - GRAM + 1
    words = _words(b)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ words[k : k + n]) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h)


def segments(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of strings, anchor's hash and segment's hash of each run of strings that elect one anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    width = LENGTH - GRAM + 1
    for begin in range(0, len(b) - LENGTH + 1, _PART):
        part = b[begin : begin + _PART + LENGTH - 1]
        h = gram_hashes(part)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size < width:  # the least of the next `size` grams, for growing sizes
            step = min(size, width - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        data = part.tobytes()
        digest = xxhash.xxh3_64_intdigest
        seg = np.fromiter((digest(data[i:j]) for i, j in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
        out.append((first + begin, count, h[anchor[first]].view(np.int64), seg.view(np.int64)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 4


def _bytes(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
        yield doc, row, np.frombuffer(text, np.uint8)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own for each row) and text. Where a doc_id stands twice the numbered rows are stored; else row is doc_id."""
    docs = texts(docs)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def _least(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows are the earliest of those with their keys; all of them if they tie."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort((start, doc, *keys))
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    least = np.zeros(len(doc), bool)
    least[order] = (doc[order] == doc[head]) & (start[order] == start[head])
    return least


_SEGMENT = "row long, start long, n long, gram long, seg long, doc_id long"
_STRING = "row long, start long, n long, h1 long, h2 long, doc_id long"

#: Rows that a task holds before it passes them on; within these, repeats are found before the shuffle.
_HELD = 1_000_000


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs with those that follow each other made one."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])])
    return doc[head], start[head], np.add.reduceat(n, head)


def _earliest_first(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of row, start, n, two keys and doc_id: of a task's rows with equal keys the earliest as they are, the others merged, without keys and doc_id."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        least = _least((columns[3], columns[4]), columns[5], columns[1])
        parts = [[pa.array(c[least]) for c in columns]]
        if not least.all():
            runs = [pa.array(c) for c in _merged(*(c[~least] for c in columns[:3]))]
            parts.append([*runs, *[pa.nulls(len(runs[0]), pa.int64())] * 3])
        for p in parts:
            whole = pa.RecordBatch.from_arrays(p, names)
            for i in range(0, whole.num_rows, 50_000):
                yield whole.slice(i, 50_000)

    n = 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= _HELD:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in small_parts(batches):
            for doc, row, b in _bytes(batch):
                if len(b) >= LENGTH:
                    start, n, gram, seg = segments(b)
                    yield np.full(len(start), row, np.int64), start, n, gram, seg, np.full(len(start), doc, np.int64)

    yield from _earliest_first(rows(), ["row", "start", "n", "gram", "seg", "doc_id"])


def _strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in small_parts(batches):
            for (doc, row, b), runs in zip(_bytes(batch), batch.column("runs").to_pylist(), strict=True):
                for begin in range(0, len(b) - LENGTH + 1, _PART):
                    part = b[begin : begin + _PART + LENGTH - 1]
                    at = [np.arange(max(r["start"], begin), min(r["start"] + r["n"], begin + _PART)) for r in runs]
                    start = np.unique(np.concatenate(at)).astype(np.int64)
                    if len(start):
                        h, i = gram_hashes(part), start - begin
                        one = mix(h[i] + mix(h[i + GRAM] + mix(h[i + LENGTH - GRAM])))
                        two = string_hashes(part, i)
                        yield np.full(len(start), row, np.int64), start, np.ones(len(start), np.int64), one.view(np.int64), two.view(np.int64), np.full(len(start), doc, np.int64)

    yield from _earliest_first(rows(), ["row", "start", "n", "h1", "h2", "doc_id"])


def _runs(rows: DataFrame) -> DataFrame:
    """row and its (start, n) as one list, which is bounded by the document's length."""
    return rows.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """row, start, n: the starts of the strings of LENGTH bytes that also start earlier, as runs of n; docs is that of _rows().

    Earlier means a smaller doc_id, or the same and a smaller start. Within a task repeats are found before the shuffle, so a string
    that very many documents hold sends one row from each task.
    """
    base = docs.select("doc_id", "row", "text")
    cut = stored(base.mapInArrow(_segments_of, _SEGMENT), "segments", release=True)
    place = F.struct("doc_id", "start")
    first = F.min(place).over(Window.partitionBy("gram", "seg"))
    group = Window.partitionBy("gram")
    sent = cut.filter("gram is not null").withColumns({"low": F.min("seg").over(group), "high": F.max("seg").over(group), "first": first})
    judged = stored(sent.filter((F.col("low") != F.col("high")) | (place > F.col("first"))).select("row", "start", "n", (place > F.col("first")).alias("repeat")), "judged", release=True)
    strings = stored(base.join(_runs(judged.filter("not repeat")), "row").mapInArrow(_strings_of, _STRING), "strings", release=True)
    found = [cut.filter("gram is null"), judged.filter("repeat"), strings.filter("h1 is null")]
    for k in range(SLICES):
        part = strings.filter(F.pmod("h1", F.lit(SLICES)) == k).withColumn("first", F.min(place).over(Window.partitionBy("h1", "h2")))
        found.append(stored(part.filter(place > F.col("first")).select("row", "start", "n"), "repeats", release=True))
    return reduce(DataFrame.union, (f.select("row", "start", "n") for f in found))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document.

    Rows of one doc_id are each judged by themselves; what they have at the same
    place is not a repeat, what starts later in one of them than in another is. A null text
    counts as empty; rows without doc_id count as of one id that is smaller than
    all others. An empty table gives no rows; columns beyond doc_id and text are
    not read.
    """
    docs = _rows(keyed(docs))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            out = []
            for (_, _, b), runs in zip(_bytes(batch), batch.column("runs").to_pylist(), strict=True):
                edge = np.zeros(len(b) + 1, np.int64)
                if runs:
                    start, n = np.array([(r["start"], r["n"]) for r in runs]).T
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), b[~gone].tobytes()))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    runs = stored(_runs(repeated_runs(docs).distinct()), "runs", release=True)
    return docs.join(runs, "row", "left").mapInArrow(cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", named())


def substring_dedup(docs: DataFrame) -> DataFrame:
    """without_repeats() with a digest of the remaining bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

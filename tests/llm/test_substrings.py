"""Removal of repeated strings, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from factorloom.llm import substring_dedup
from tests.llm.conftest import DOCS, rows
from tests.llm.test_models import brute_groups
from tests.llm.test_native import brute_contamination


def brute_repeats(data):
    seen, out = set(), {}
    for d, t in sorted(data):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = {"doc_id": d, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
    return out


def random_texts():
    rng = np.random.default_rng(1)
    pool = ["".join(rng.choice(list("abcdé "), n)) for n in (30, 99, 100, 101, 140, 160, 400)] + ["z" * 150, "ab" * 90]
    return [(500 - k, "".join(pool[i][rng.integers(0, 9) :] for i in rng.integers(0, len(pool), rng.integers(0, 7)))) for k in range(120)]


def test_substrings(spark, docs, empty, monkeypatch):
    assert rows(substring_dedup.substring_dedup(docs)) == brute_repeats(DOCS)
    data = random_texts()
    frame = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, start int").repartition(5)
    assert rows(substring_dedup.substring_dedup(frame)) == brute_repeats(data)
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(docs.union(docs)).count() == 2 * len(DOCS)


def test_substrings_of_the_sample(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(substring_dedup.substring_dedup(frame)) == brute_repeats([(r.doc_id, r.text) for r in frame.collect()])


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    b = rng.integers(97, 99, 3000).astype(np.uint8)
    whole = substring_dedup.segments(b)
    monkeypatch.setattr(substring_dedup, "_PART", 256)
    parts = substring_dedup.segments(b)
    assert whole[1].sum() == parts[1].sum() == 2901 and set(whole[0].tolist()) <= set(parts[0].tolist())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in at.collect()}
        assert at.columns == docs.columns and after.items() <= before.items()
        if name == "quality":
            wrong = [k for k in before if k in labels and (k in after) != labels[k]]
            assert len(wrong) <= 0.02 * len(before)
        elif name == "exact_dedup":
            assert sorted(after) == sorted({t: max(k for k, u in before.items() if u == t) for t in before.values()}.values())
        elif name == "near_dedup":
            assert set(after) == set(brute_groups(sorted(before.items())).values())
        else:
            assert set(after) == {k for k, v in brute_contamination(before.items(), items).items() if not v["contaminated"]}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(after)


@pytest.mark.parametrize("table", [lambda p, q: [(None, p), (None, q + p), (None, "x" * 20)], lambda p, q: [(1, p), (2, q + p), (2, "short text")], lambda p, q: [(2, q + p), (2, p), (2, None), (5, p), (None, p[:150])]])
def test_rows_that_share_an_id(spark, table):
    p, q = (" ".join(f"{w}{i * i % 89}" for i in range(60)) for w in ("pa", "qu"))
    data = table(p, q)
    got = substring_dedup.without_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(2)).collect()
    strings = {}
    for doc, text in data:
        b = (text or "").encode()
        for i in range(len(b) - 99):
            strings[b[i : i + 100]] = min(strings.get(b[i : i + 100], (1 << 62, 0)), (-1 if doc is None else doc, i))
    want = []
    for doc, text in data:
        b, gone = (text or "").encode(), set()
        for i in range(len(b) - 99):
            if strings[b[i : i + 100]] < (-1 if doc is None else doc, i):
                gone |= set(range(i, i + 100))
        want.append((doc, len(b), len(gone), bytes(x for i, x in enumerate(b) if i not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=key) == sorted(want, key=key)

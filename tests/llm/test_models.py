"""The quality classifier by held-out accuracy, near duplicates against brute force."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from factorloom.llm import components, minhash, quality
from tests.llm.conftest import DOCS, PASSAGE, rows

SF = "/root/testdata/sf0.01"


def test_quality(spark, docs, empty):
    frame, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got, marks = rows(quality.quality_scores(frame, labels)), {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == frame.count()
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(marks[k], r["predicted"]) for k, r in got.items() if r["held_out"] and k in marks]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in rows(quality.quality_scores(docs, labels.limit(0))).values()} == {0.5}
    assert len(rows(quality.quality_scores(docs, labels))) == len(DOCS)
    assert quality.keep_good(frame, labels).columns == frame.columns


def test_held_out_labels_are_not_used(spark):
    frame, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = rows(quality.quality_scores(frame, labels)), rows(quality.quality_scores(frame, other))
    assert {k: r["score"] for k, r in a.items()} == {k: r["score"] for k, r in b.items()}


def brute_groups(data):
    sets = {}
    for d, t in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else {("text", t or "")}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        by.setdefault(frozenset(s), []).append(d)
    heads = {d[0]: s for s, d in by.items()}
    for g in by.values():
        for x in g[1:]:
            root[top(x)] = top(g[0])
    for (a, s), (b, t) in combinations(heads.items(), 2):
        if min(len(s), len(t)) >= 0.8 * max(len(s), len(t)) and len(s & t) >= 0.8 * len(s | t):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    out = {}
    for d in sets:
        out.setdefault(top(d), []).append(d)
    return {d: min(g) for g in out.values() for d in g}


def chain():
    """Texts of which only neighbours are similar, and a group whose members all differ a little."""
    words = [f"w{i}" for i in range(400)]
    step = [(200 + k, " ".join(words[8 * k : 8 * k + 120])) for k in range(12)]
    near = [(300 + k, " ".join(words[:150] + [f"own{k}"] + words[150:300])) for k in range(30)]
    return [*step, *near, (400, PASSAGE + " more"), (401, PASSAGE.upper() + "!! more")]


def test_near_duplicates(spark, docs, empty):
    data = DOCS + chain()
    frame = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(*r, "x") for r in chain()], "doc_id long, text string, lang string"))
    want = brute_groups(data)
    got = rows(minhash.near_duplicates(frame))
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == want[k]) and r["group_size"] == sum(v == want[k] for v in want.values()) for k, r in got.items())
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(frame).collect()) == sorted(set(want.values()))
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(docs.union(docs)).count() == minhash.drop_near_duplicates(docs).count()


@pytest.mark.parametrize("turns", [0, 3])
def test_group_of_copies_around_the_threshold(spark, monkeypatch, turns):
    monkeypatch.setattr(minhash, "HEAD_TURNS", turns)
    random, words = np.random.default_rng(5), [f"w{i}" for i in range(150)]
    data = [(k, " ".join(f"own{k}x{i}" if random.random() < 0.002 * (k % 14) else w for i, w in enumerate(words))) for k in range(150)]
    want = brute_groups(data)
    assert 3 < len(set(want.values())) < 140
    assert {k: r["class_id"] for k, r in rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))).items()} == want


def test_copies_whose_lines_repeat_another_number_of_times(spark):
    data = []
    for k in range(10):
        words, line = [f"u{k}x{i}" for i in range(100)], " ".join(f"line{k}x{i}" for i in range(60))
        data.append((2 * k, "\n".join([" ".join(words), *[line] * 2])))
        data.append((2 * k + 1, "\n".join([" ".join([*words[:50], "other", *words[51:]]), *[line] * 200])))
    want = brute_groups(data)
    assert all(want[i] == i // 2 * 2 for i in want)
    assert {k: r["class_id"] for k, r in rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))).items()} == want


def test_near_duplicates_of_the_sample(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in frame.collect()])
    assert {k: r["class_id"] for k, r in rows(minhash.near_duplicates(frame)).items()} == want


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_jaccard(weighted):
    rng = np.random.default_rng(7)
    e = minhash.mix(np.arange(1, 301, dtype=np.uint64))
    w = rng.uniform(0.2, 9, 300) if weighted else np.ones(300)
    v = np.where(rng.random(300) < 0.2, rng.uniform(0.2, 9, 300) if weighted else 0, w)
    k = 2000
    a, b = minhash.dart_minhash([(e, w), (e[v > 0], v[v > 0])], k)
    assert (a == minhash.dart_minhash([(e, w)], k)[0]).all()
    assert abs((a == b).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(300, 299), (299, 301), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 300: 299, 301: 299}

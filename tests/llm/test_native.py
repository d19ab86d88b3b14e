"""Exact dedup, decontamination and license scans against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from factorloom.llm import decontamination, exact_dedup, licenses
from tests.llm.conftest import DOCS, ITEMS, PASSAGE, rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sample(spark, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]


def test_exact_duplicates(spark, docs, empty):
    for data, frame in ((DOCS, docs), (sample(spark), spark.read.parquet(f"{SF}/documents.parquet"))):
        groups = defaultdict(list)
        for i, t in data:
            groups[t or ""].append(i)
        got = rows(exact_dedup.exact_duplicates(frame))
        assert len(got) == len(data)
        for i, t in data:
            g = groups[t or ""]
            assert got[i] == {"doc_id": i, "keep_id": max(g), "group_size": len(g), "kept": i == max(g), "text_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
        kept = exact_dedup.deduplicate(frame)
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.deduplicate(docs.union(docs)).count() == exact_dedup.deduplicate(docs).count()


def brute_contamination(data, items):
    lists = {i: words(t) for i, t in items}
    out = {}
    for d, t in data:
        w = words(t)
        hit, found = set(), set()
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, x in lists.items():
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in at[x[s]]:
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[d] = {"doc_id": d, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit) and 20 * len(hit) >= len(w)}
    return out


def test_contamination(spark, docs, empty):
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, pos int")
    assert rows(decontamination.contamination(docs, bench)) == brute_contamination(DOCS, ITEMS)
    assert decontamination.contamination(empty, bench).count() == 0
    assert all(not r["contaminated"] for r in rows(decontamination.contamination(docs, bench.limit(0))).values())
    got = rows(decontamination.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert got == brute_contamination(sample(spark), sample(spark, "benchmark"))
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {k for k, v in brute_contamination(DOCS, ITEMS).items() if not v["contaminated"]}


def test_shuffled_lookup_gives_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontamination, "small", lambda df: df)
    assert rows(decontamination.contamination(docs, bench)) == brute_contamination(DOCS, ITEMS)


def test_repeated_and_clashing_items(spark, docs):
    """Rows that share an item_id are matched each, a repeated row as if it stood once, and a null item_id too."""
    words_of = PASSAGE.split()
    clash = " ".join([*words_of[:20], "and", "then", "another", "end"])
    items = [(1, PASSAGE), (1, PASSAGE), (1, clash), (2, "lima mike november"), (2, "lima mike november"), (2, "papa"), (3, " ".join(words_of[3:16]).upper()), (3, " ".join(words_of[3:16])), (8, "x x"), (8, None)]
    data = [*DOCS, (500, clash), (501, "says " + " ".join(words_of[:13]))]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(data[-2:], "doc_id long, text string"))
    single = [brute_contamination(data, [x]) for x in items]
    places = rows(decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string")))
    for d, _ in data:
        found = sorted({str(i) for (i, _), one in zip(items, single, strict=True) if one[d]["n_hit"]})
        assert places[d]["n_items"] == len(found) and places[d]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    apart = brute_contamination(data, [(k, t) for k, (_, t) in enumerate(items)])
    assert {d: (r["n_hit"], r["contaminated"]) for d, r in places.items()} == {d: (r["n_hit"], r["contaminated"]) for d, r in apart.items()}
    assert places[500]["n_items"] > 0 and places[501]["n_items"] > 0
    unnamed = rows(decontamination.contamination(frame, spark.createDataFrame([(None, PASSAGE), (None, PASSAGE)], "item_id long, text string")))
    assert unnamed[5]["n_hit"] == 26 and unnamed[5]["n_items"] == 1 and unnamed[5]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_proximity(spark, docs):
    pairs = spark.createDataFrame([(1, "alpha", "delta"), (2, "november", "lima"), (3, "alpha", "zulu")], "pair_id int, term_a string, term_b string")
    got = {tuple(r) for r in decontamination.proximity_matches(docs, pairs, 4).collect()}
    want = set()
    for d, t in DOCS:
        w = words(t)
        for k, a, b in ((1, "alpha", "delta"), (2, "november", "lima"), (3, "alpha", "zulu")):
            want |= {(k, d, i, j) for i in range(len(w)) if w[i] == a for j in range(max(0, i - 4), i + 5) if j < len(w) and w[j] == b and i != j}
    assert got == want


def brute_licenses(data):
    out = {}
    for d, t in data:
        w = words(t)
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        near, best = set(), 0.0
        for line in (t or "").split("\n"):
            tokens = set(words(line))
            for label, wording in licenses.TEMPLATES.items():
                s = set(wording.split())
                if tokens and len(tokens & s) >= 0.8 * len(s):
                    near.add(label)
                    best = max(best, len(tokens & s) / len(s))
        base = {x for _, x in hits}
        out[d] = {"doc_id": d, "n_words": len(w), "n_base": len(hits), "first_word": min((i for i, _ in hits), default=None), "last_word": max((i for i, _ in hits), default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | near)), "score": 1.0 if hits else best}
    return out


def test_notices_over_several_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"
    mit = "Released under\nthe MIT\nLicense"
    lead = " ".join(f"w{i}" for i in range(45))
    data = [(1, bsd), (2, mpl), (3, mit), (4, "released under\n" + lead + "\nthe license"), (5, "no notice\nhere"), *[(10 + k, f"{' '.join(lead.split()[:k])}\n{mpl}\n{lead}") for k in range(36)], (60, "\n\n"), (61, None)]
    near = lambda **more: {i: (r["labels"], r["score"]) for i, r in rows(licenses.license_scan(spark.createDataFrame(data, "doc_id long, text string"), **more)).items()}
    got = near()
    assert got[1] == ("bsd", 1.0) and got[2] == ("mpl-2", 1.0) and got[3] == ("mit", 1.0) and got[4] == got[5] == got[60] == got[61] == ("", 0.0)
    assert all(got[10 + k] == ("mpl-2", 1.0) for k in range(36))
    longest, want = max(len(words(v)) for v in licenses.TEMPLATES.values()), {}
    for d, t in data:
        w = words(t)
        blocks = [set(words(x)) for x in (t or "").split("\n")] + [set(w[i : i + longest]) for i in range(max(len(w) - longest, 0) + 1)]
        best = {label: max(len(b & set(words(v))) / len(set(words(v))) for b in blocks) for label, v in licenses.TEMPLATES.items()}
        found = {k: v for k, v in best.items() if v >= 0.8}
        want[d] = (",".join(sorted(found)), max(found.values(), default=0.0))
    assert got == want
    shouted = near(templates={"mpl": "Mozilla Public License, Version 2.0", "own": "RELEASED under the MIT-License"}, threshold=0.75)
    assert shouted[3] == ("own", 1.0) and shouted[2][0] == "mpl"
    assert near(templates={})[1] == ("", 0.0)


def test_license_scan(spark, docs, empty):
    assert rows(licenses.license_scan(docs)) == brute_licenses(DOCS)
    assert licenses.license_scan(empty).count() == 0
    assert rows(licenses.license_scan(spark.read.parquet(f"{SF}/documents.parquet"))) == brute_licenses(sample(spark))

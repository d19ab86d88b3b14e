"""The Merkle manifest against a plain tree in Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root of nodes and each one's (siblings, is it the right one) on the way."""
    ways, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for k, part in enumerate(at[i : i + 2]):
                for j in part:
                    ways[j].append((pair[1 - k] if len(pair) == 2 else "", k == 1))
            up.append(h(*pair))
            held.append(sum(at[i : i + 2], []))
        nodes, at = up, held
    return nodes[0], ways


def climb(digest, way):
    for other, right in way:
        digest = h(other, digest) if right else h(digest, other)
    return digest


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for *_, leaf, _ in sorted(by[x], key=lambda t: t[:3])]) for x in langs}
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (_, _, leaf, r), way in zip(sorted(by[x], key=lambda t: t[:3]), trees[x][1], strict=True):
            told = r[3] if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else r[3] + 1
            end = climb(leaf_of(*r[:3], told, r[4]), way + top)
            out.append((r[0], leaf, trees[x][0], root, h(*(s for s, _ in way + top)), end, end == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest(spark, levels):
    langs = ["en"] * 40 + ["de"] * 7 + [None] * 3 + ["ß"] + ["a"] * 2 + [""] * 4
    rows = [(i * 37 % 60, f"s{i % 3}" if i % 5 else None, x, i if i % 4 else None, None if i == 9 else f"texté {i}" * (i % 3)) for i, x in enumerate(langs)]
    rows += [(None, None, "en", 5, "no id"), (None, None, None, None, None), rows[0], rows[0], (rows[0][0], "other", "en", 1, "same id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    got = merkle.manifest(df, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_lone_leaf_empty_table_and_largest_number(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = (3, "s", "en", 4, "abcd")
    got = merkle.manifest(spark.createDataFrame([one], kind)).first()
    assert got.leaf == got.subroot == got.root == leaf_of(*one) and got.proof_sha256 == h()
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0
    tampered = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 0)
    last = merkle.manifest(spark.createDataFrame([(tampered, "s", "en", (1 << 63) - 1, "t")], kind)).first()
    assert not last.verified


def test_blocks_are_the_tree(spark):
    for n in (1, 2, 3, 5, 8, 13):
        digests = [h(str(i)) for i in range(n)]
        root, siblings = merkle.traversed(digests, (n - 1).bit_length())
        want, ways = tree(digests)
        assert root == want and [[s or "" for s in x] for x in siblings] == [[s for s, _ in w] for w in ways]


def test_query_takes_the_table(spark):
    got = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert Counter(tuple(r) for r in got.collect()) == brute([tuple(r) for r in docs.collect()])
    assert got.filter(F.col("verified") == (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)).count() == 0

"""Nulls in every column, repeated rows, empty tables and clashing names; long texts over several parts; damaged outputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorloom.llm import chat, decontamination, exact_dedup, licenses, minhash, packing, quality, queries, secrets, substring_dedup, token_files
from tests.llm.conftest import ITEMS, NOTICE, PASSAGE, SECRET, rows
from tests.llm.test_native import brute_contamination
from tests.llm.test_substrings import brute_repeats
from tests.llm.test_tokens import crc, ids_of

TEXT = "The river was wide and slow, and people came from both of its banks to trade."
ODD = [(None, PASSAGE), (None, PASSAGE), (None, None), (3, PASSAGE), (3, PASSAGE), (4, TEXT), (4, NOTICE), (5, SECRET), (6, None), (7, "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if k % 2 else "x", 1.5, k, True) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, lang string, score double, bad long, again boolean")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([*ITEMS, (None, None)], "item_id long, text string")


def test_every_row_is_returned(spark, odd, bench):
    labels = spark.createDataFrame([(None, 1), (4, None), (5, 0), (6, 1)], "doc_id long, quality int")
    for df in (
        quality.quality_scores(odd, labels), minhash.near_duplicates(odd), substring_dedup.substring_dedup(odd), exact_dedup.exact_duplicates(odd), secrets.secret_digests(odd), licenses.license_scan(odd), decontamination.contamination(odd, bench), token_files.token_files(odd),
    ):
        got = df.select("doc_id").collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in ODD)
    assert packing.packed_pieces(odd).count() == len(ODD)


def test_rows_without_id(spark, odd, bench):
    exact = [r for r in exact_dedup.exact_duplicates(odd).collect() if r.doc_id is None]
    assert sorted((r.keep_id, r.group_size, r.kept) for r in exact) == [(3, 4, False), (3, 4, False), (7, 3, False)]
    near = [r for r in minhash.near_duplicates(odd).collect() if r.doc_id is None]
    assert all(r.class_id is None and r.kept and r.group_size == 1 for r in near) and len(near) == 3
    hit = [r for r in decontamination.contamination(odd, bench).collect() if r.doc_id is None]
    assert sorted((r.n_words, r.contaminated) for r in hit) == [(0, False), (26, True), (26, True)]
    marked = [r for r in licenses.license_scan(odd.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))).collect() if r.n_base]
    assert len(marked) == 1 and marked[0].doc_id is None and "mit" in marked[0].labels


def test_rows_are_judged_by_their_own_text(spark, bench):
    data = [(None, PASSAGE), (None, TEXT), (None, NOTICE), (1, TEXT), (1, PASSAGE), (1, TEXT), (2, NOTICE), (2, PASSAGE + " " + NOTICE)]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, hash int")
    alone = brute_contamination(list(enumerate(t for _, t in data)), ITEMS)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(frame, bench).collect()))
    assert got == sorted((i or 0, *(alone[k][c] for c in ("n_words", "n_hit", "n_items", "contaminated"))) for k, (i, _) in enumerate(data))
    left = decontamination.decontaminate(frame, bench)
    assert left.columns == frame.columns and sorted(r.hash for r in left.collect()) == [k for k, v in alone.items() if not v["contaminated"]]
    single = {t: licenses.license_scan(spark.createDataFrame([(0, t)], "doc_id long, text string")).first() for t in {t for _, t in data}}
    licensed = sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in licenses.license_scan(frame).collect())
    assert licensed == sorted((i or 0, single[t].n_words, single[t].labels, single[t].score) for i, t in data)


def test_packing_spreads_rows_without_id(spark):
    big = (1 << 53) + 1
    data = [*[(None, "the same text")] * 40, *[(big + k, "another text " * k) for k in range(40)]]
    kept = packing.stored(packing.pieces(spark.createDataFrame(data, "doc_id long, text string"), 16, with_ids=False).drop("ids").withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = packing.pack(kept, len(data), 16, group_docs=8).collect()
    assert sorted({r.doc_id for r in placed if r.doc_id is not None}) == [big + k for k in range(40)]
    assert len({r.sequence_id >> 32 for r in placed if r.doc_id is None}) > 3 and len(placed) == kept.count()
    assert placed[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    for s in {r.sequence_id for r in placed}:
        at = 0
        for r in sorted((r for r in placed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 16


def test_stages_keep_the_rest(spark, odd, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    at = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == odd.columns
        got = sorted((r.doc_id or 0, r.text or "") for r in at.collect())
        if name == "quality":
            assert len(got) == len(ODD)
        else:
            assert got == [(3, PASSAGE), (4, NOTICE), (4, TEXT), (5, SECRET), (7, "")], name
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {3, 4, 5, 7}
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_conversations_with_nulls(spark):
    data = [(None, None, None, None), (None, 1, "user", "hi"), (1, None, "user", "first"), (1, 2, "assistant", None)]
    got = rows(chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")), "conv_id")
    assert got[None]["n_turns"] == 2 and got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0


def test_damaged_tree_is_noticed(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", "more")]
    turns = chat.paths(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    leaves = turns.filter("last").select("conv_id", "path")
    tree = spark.createDataFrame(chat.prefix_tree(turns).collect(), chat.prefix_tree(turns).schema)
    good = rows(chat.read_back(tree, leaves), "conv_id")
    assert good[2]["n_turns"] == 3 and good[2]["loss_chars"] == 5
    at = F.col("depth") == 1
    for name, damaged in {"until": F.when(at, F.col("until") - 1000), "position": F.col("position") + 1, "loss_start": F.col("loss_start") + 1, "start": F.when(at, F.col("start") + 1), "end": F.when(at, F.col("end") + 1), "last": ~F.col("last")}.items():
        bad = tree.withColumn(name, F.coalesce(damaged, F.col(name)))
        if name in ("start", "end"):
            with pytest.raises(Exception, match="has a place of"):
                chat.read_back(bad, leaves).collect()
        else:
            assert rows(chat.read_back(bad, leaves), "conv_id") != good, name
    closed = tree.withColumn("until", F.when(~at, F.col("until") + 1000).otherwise(F.col("until")))
    assert rows(chat.read_back(closed, leaves), "conv_id") != good


def test_any_sequence_can_be_read(spark, tmp_path):
    data = [(k, " ".join(f"word{k * i % 97}" for i in range(3000 + 700 * k))) for k in range(8)]
    folder = f"file://{tmp_path}/out"
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    files = token_files.write_token_files(frame, folder, sequence=64, batch=16)
    at = 0
    for f in sorted(files.collect(), key=lambda f: f.part):
        held = token_files.TokenFile(token_files._filesystem(folder)[0], f.path)
        every = held.ids(0, f.n_ids)
        last = -(-f.n_ids // 64) - 1
        for row in (last, 0, last // 2, 17, 3, last):
            ids, mask = token_files.sequence_at(folder, f.path, row)
            assert ids[mask].tolist() == every[64 * row : 64 * row + 64].tolist()
        with pytest.raises(IndexError):
            token_files.sequence_at(folder, f.path, last + 1)
        with pytest.raises((ValueError, IndexError)):
            held.ids(f.n_ids - 1, 2)
        damaged = token_files.TokenFile(token_files._filesystem(folder)[0], f.path)
        damaged.size += 8
        with pytest.raises(Exception):  # noqa: B017
            assert damaged.ids(64 * 16, 10).tolist() == every[64 * 16 : 64 * 16 + 10].tolist()
        at += f.n_docs
    assert at == len(data)
    got = rows(token_files.read_documents(files, folder))
    assert {k: (got[k]["n_tokens"], got[k]["ids_crc32"]) for k, _ in data} == {k: (len(ids_of(t)), crc(ids_of(t))) for k, t in data}


def test_contamination_of_long_texts_without_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for name in ("small", "small_ids"):
        monkeypatch.setattr(decontamination, name, lambda df: df)
    long = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 400, 20_000).tolist()[k:])
    first = long(0).split()
    items = [(k, " ".join(first[100 * k : 100 * k + 30])) for k in range(20)] + [(50, "w1 w1"), (51, "w3")]
    data = [(1, " ".join(first)), (2, long(5)), (3, " ".join(first[150:]) + " " + long(100)), (4, " ".join(first[105:118]))]
    got = rows(decontamination.contamination(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute_contamination(data, items)


def test_substrings_over_the_border_of_parts(spark):
    rng = np.random.default_rng(4)
    part, letters = 1 << 19, list("abcdefgh")
    run = "".join(rng.choice(letters, 700))
    body = "".join(rng.choice(letters, part - 300))
    data = [(1, body + run + "".join(rng.choice(letters, 5000))), (2, "x" * 50 + run + "y" * 50), (3, "z" * (part - 40) + run[:150])]
    got = rows(substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == brute_repeats(data) and got[2]["n_removed"] == 700


def test_classifier_against_plain_numpy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    measured = quality.document_statistics(docs)
    model = quality.fit(measured, labels)
    x = {r.doc_id: r.x for r in measured.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    part = {r.doc_id: r.f for r in docs.select("doc_id", quality.fold().alias("f")).collect()}
    train = sorted(k for k in marks if k in x and part[k])
    every = np.array([x[k] for k in train])
    np.testing.assert_allclose(model.mean, every.mean(0), atol=1e-9)
    np.testing.assert_allclose(model.scale, np.sqrt(np.maximum(every.var(0), 1e-6)), rtol=1e-6)
    body = [k for k in train if part[k] != 1]
    z = np.clip((np.array([x[k] for k in body]) - model.mean) / model.scale, -6, 6) @ model.directions + model.phases
    f = np.hstack([np.cos(z) * np.sqrt(2 / quality.N_FEATURES), np.ones((len(z), 1))])
    m = quality.N_FEATURES + 1
    want = np.linalg.solve(f.T @ f + quality.RIDGE * len(f) / quality.N_FEATURES * np.eye(m), f.T @ np.array([marks[k] for k in body], float))
    np.testing.assert_allclose(f @ model.weights, f @ want, atol=1e-6)
    curve = [k for k in train if part[k] == 1]
    raw, y = model.raw(np.array([x[k] for k in curve])), np.array([marks[k] for k in curve], float)
    order = np.argsort(raw, kind="stable")
    blocks = []  # pool adjacent violators: sum, count
    for v in y[order]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v, n = blocks.pop()
            blocks[-1][0] += v
            blocks[-1][1] += n
    pooled = np.concatenate([np.full(n, v / n) for v, n in blocks])
    np.testing.assert_allclose(np.interp(raw[order], model.levels, model.chances), pooled, atol=1e-6)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    from factorloom.llm.tokens import WordCoder

    with pytest.raises(ValueError):
        WordCoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_control_strings_come_back(spark):
    got = rows(queries.op6_chat_format(spark, "/root/testdata/sf0.001"), "conv_id")
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]")

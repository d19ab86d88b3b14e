"""Packing and token files against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factorloom.llm import packing, token_files, tokens
from tests.llm.conftest import DOCS, rows

PATH = tokens.default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBcé.,!' \n\t0١<|endoftxsr>ΣİǅKſ́\x85 　'٣#ö-", max_size=60))
def test_words_encode_as_whole_texts(text):
    assert tokens.coder(PATH).encode(text).tolist() == ids_of(text)


def test_special_strings_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    code = tokens.WordCoder(PATH)
    for text in ["<|endoftext|> a<|endoftext|>b", "it's we'll. 3.14, x", "one two three four five six", "six five. four", *(t or "" for _, t in DOCS)]:
        assert code.encode(text).tolist() == ids_of(text)


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 200):
        lengths = sorted(rng.integers(1, 100, n).tolist(), reverse=True)
        room, want = [], []
        for x in lengths:
            k = next((i for i, r in enumerate(room) if r >= x), len(room))
            room += [100] * (k == len(room))
            want.append((k, 100 - room[k]))
            room[k] -= x
        assert list(zip(*packing.first_fit(lengths, 100), strict=True)) == want
    with pytest.raises(ValueError):
        packing.first_fit([101], 100)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, docs, empty, capacity):
    out = [r.asDict() for r in packing.packed_pieces(docs, capacity).collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == dict(DOCS).keys()
    for d, t in DOCS:
        ids, at = ids_of(t), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert packing.packed_pieces(empty).count() == 0
    cut, placed = packing.pieces(docs, capacity), spark.createDataFrame(out)
    for r in packing.sequences(placed, cut, capacity).collect():
        held = np.frombuffer(r.ids, "<u4")
        assert len(held) == capacity
        for p in by_sequence[r.sequence_id]:
            assert crc(held[p["offset"] : p["offset"] + p["length"]]) == p["ids_crc32"]


def test_little_padding(spark):
    frame = packing.packed_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = frame.selectExpr("sum(length)", "count(distinct sequence_id) * 4096").first()
    assert r[0] / r[1] > 0.98


def test_token_files(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/out"
    got = rows(token_files.token_files(docs, folder=folder))
    at = 0
    for d, t in sorted(DOCS):
        ids = ids_of(t)
        assert got[d] == {"doc_id": d, "start": at, "n_tokens": len(ids), "ids_crc32": crc(ids)}
        at += len(ids)
    stream = []
    for f in sorted((tmp_path / "out").glob("*.ids.arrows")):
        row = 0
        while True:
            try:
                ids, mask = token_files.sequence_at(folder, str(f), row)
            except IndexError:
                break
            assert len(ids) == len(mask) == token_files.SEQUENCE
            stream += ids[mask].tolist()
            row += 1
    assert stream == [x for _, t in sorted(DOCS) for x in ids_of(t)]
    assert token_files.token_files(empty).count() == 0
    assert token_files.token_files(docs.union(docs)).count() == 2 * len(DOCS)

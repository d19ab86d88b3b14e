"""Token counts of prefixes against the tokenizer itself."""

from __future__ import annotations

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import queries, token_counts
from factorloom.llm.tokens import default_tokenizer
from tests.llm.conftest import DOCS, rows

PATH = default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)


def brute(text):
    return [len(e.ids) for e in TOKENIZER.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


def counted(text):
    return [0, *np.cumsum(np.frombuffer(token_counts.counter(PATH).steps(text), "<i2"), dtype=int).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBcé.,!' \n\t0١<|endoftxsr>ΣİǅKſ́\x85 　'٣#öngilvm\x1f​漢", max_size=50))
def test_every_prefix_of_odd_characters(text):
    assert counted(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aȩ̣́oABs'rel 한가İ　ßﬁÅ̈\U0001f600אกำ" + unicodedata.normalize("NFD", "한각"), max_size=40))
def test_every_prefix_of_joined_characters(text):
    assert counted(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "'", "r", "e", "<|", "|>", "the", "ing", "tion", "é", " "]), max_size=12).map("".join))
def test_special_strings_and_endings(text):
    assert counted(text) == brute(text)


def test_long_words_and_forgetting(monkeypatch):
    for text in ("a" * 3000, "ab" * 700, "the" * 400, "aé" * 300, unicodedata.normalize("NFD", "한" * 60)):
        assert counted(text)[-1] == brute(text)[-1]
    text = "x" * 90 + "the" * 40
    assert counted(text) == brute(text)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 2)
    monkeypatch.setattr(token_counts, "KEPT_PAIRS", 2)
    for text in ("one two three it's we'll, the others'", "six five two THREE", *(t for _, t in DOCS if t and len(t) < 300)):
        assert counted(text) == brute(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(PATH.replace("word_bpe_49k", "byte_bpe_50k"))


def test_counts_of_rows(spark, docs, empty):
    twice = docs.union(docs.filter("doc_id in (5, 7)")).union(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    out = [r.asDict() for r in token_counts.token_counts(twice, limit=10).collect()]
    assert len(out) == len(DOCS) + 3 and sorted(out[0]) == ["doc_id", "kept_chars", "n_bytes", "n_tokens", "over_limit"]
    said = {**dict(DOCS), None: "same text here"}
    for r in out:
        text = said[r["doc_id"]] or ""
        want = brute(text) if len(text) < 1000 else [0] * len(text) + [len(TOKENIZER.encode(text, add_special_tokens=False).ids)]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), want[-1], want[-1] > 10)
        if len(text) < 1000:
            assert r["kept_chars"] == max(i for i, n in enumerate(want) if n <= 10)
    assert token_counts.token_counts(empty).count() == 0


def test_questions_over_stored_rows(spark):
    text = {1: "the whole thing, isn't it? " * 5, 2: "", 3: "é" * 40 + " unbelievable"}
    docs = spark.createDataFrame([*text.items(), (None, "no name"), (4, None)], "doc_id long, text string")
    held = token_counts.prefix_counts(docs, chunk=16)
    assert held.groupBy("row_id").agg(F.count("*").alias("n"), F.sum(F.col("last").cast("int")).alias("ends")).filter("ends != 1").count() == 0
    places = [(i, n) for i, t in text.items() for n in (0, 1, 15, 16, 17, 32, len(t))] + [(1, -1), (1, 10_000), (1, None), (9, 3), (None, 2), (4, 0)]
    got = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.counts_at(held, spark.createDataFrame(places, "doc_id long, n_chars long"), chunk=16).collect()}
    for i, n in places:
        if i in text and n is not None:
            assert got[i, n] == (brute(text[i])[n] if 0 <= n <= len(text[i]) else None), (i, n)
    assert got[1, None] is None and got[4, 0] == 0 and (9, 3) not in got and (None, 2) not in got
    for limit in (-1, 0, 1, 3, 7, 1000):
        kept = rows(token_counts.longest_prefixes(held, limit))
        for i, t in text.items():
            fits = [k for k, n in enumerate(brute(t)) if n <= limit]
            assert kept[i]["kept_chars"] == (max(fits) if fits else None)
            assert kept[i]["kept_tokens"] == (brute(t)[max(fits)] if fits else None)
    own = rows(token_counts.longest_prefixes(held, F.when(F.col("doc_id") == 1, 3)))
    assert own[1]["kept_tokens"] <= 3 and own[3]["kept_chars"] == len(text[3])


def test_query_counts_whole_table(spark):
    got = rows(queries.op11_token_counts(spark, "/root/testdata/sf0.001"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(TOKENIZER.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[d.doc_id]["n_tokens"], got[d.doc_id]["n_bytes"], got[d.doc_id]["over_limit"]) == (n, len((d.text or "").encode()), n > 2048)
        if n > 2048:
            assert len(TOKENIZER.encode(d.text[: got[d.doc_id]["kept_chars"]], add_special_tokens=False).ids) <= 2048

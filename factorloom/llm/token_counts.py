"""Exact token counts of every prefix of a text, kept so that questions about lengths need no tokenizer.

The tokenizer is a byte-pair encoding with word ends. Its encoding of a text is
the only sequence of tokens of which each neighbouring pair would be left apart
by the merges. So the encoding of a prefix is that of a shorter prefix and one
more token: going through a word once, the count of each prefix follows from
those before it. A pair of tokens is left apart unless some piece at the end of
the first and some piece at the start of the second merge before either of them
goes into a larger piece of its own token.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_ids, stored
from factorloom.llm.tokens import default_tokenizer, small_parts

#: Prefixes to a stored row, and the token limit of the query.
CHUNK, LIMIT = 8192, 2048
#: Words and token pairs that a worker keeps; what is forgotten is only counted again.
KEPT_WORDS, KEPT_PAIRS = 300_000, 500_000

_PLAIN = re.compile(r"[!-~]*")
#: How the tokenizer cuts lower-cased text of printable ASCII into words.
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LONG_ENDINGS = ("'re", "'ve", "'ll")
_PREFIXES = "row_id long, doc_id long, n_bytes long, n_chars long, n_tokens long, start long, base long, least long, last boolean, steps binary"


@cache
def _joins_before() -> frozenset[str]:
    """Characters that a normalisation may join with the one before them."""
    second = (unicodedata.decomposition(chr(i)).split() for i in range(0x110000))
    found = {chr(int(d[1], 16)) for d in second if len(d) == 2 and not d[0].startswith("<")}
    return frozenset(found | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


class _After(dict):
    """token: whether it stays apart from the token before it, looked up once."""

    def __init__(self, counter: PrefixCounter, before: str):
        self.counter, self.before = counter, before

    def __missing__(self, token: str) -> bool:
        self.counter.n_pairs += 1
        fits = self[token] = self.counter._apart(self.before, token)
        return fits


class PrefixCounter:
    """Token counts of all prefixes, with the tokenizer file at `path`.

    The file must be a byte-level BPE with ends of words whose normaliser and
    word rule are those of `_CUT`, and whose merges come after the merges of
    their parts; any other is refused. Normalising and cutting of characters
    beyond printable ASCII is left to the tokenizer's own parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cuts = told["model"], json.dumps(told["pre_tokenizer"])
        rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or json.dumps(rule) not in cuts or '"ByteLevel"' not in cuts or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not the kind of tokenizer that is counted here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        made = {w: self.rank[p] for w, p in self.parts.items()}
        if len(made) != len(merges) or any(made.get(x, -1) >= i for i, m in enumerate(merges) for x in m):
            raise ValueError(f"{path}: a merge comes before those of its parts")
        self.made = made
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        words = set(model["vocab"])
        bad = {w for w, (a, b) in self.parts.items() if not self._apart(a, b, made[w])}  # no text gives such a token
        kinds = {(t := w.removesuffix("</w>")): (len(t), t if t in words and t not in bad else None, f"{t}</w>" if f"{t}</w>" in words and f"{t}</w>" not in bad else None) for w in words}
        self.longest = max(map(len, kinds))
        self.tokens = ahocorasick.Automaton()
        for t, kind in kinds.items():
            self.tokens.add_word(t, kind)
        self.tokens.make_automaton()
        special = [t["content"] for t in told["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marked = re.compile("[" + re.escape("".join({s[0] for s in special})) + "]").search if special else lambda _: None
        self.pairs: dict[str, _After] = {}
        self.n_pairs, self.words = 0, {}
        letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the bytes that stand for themselves
        shown = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
        self.inner = {shown[b] for b in range(0x80, 0xC0)}  # bytes inside a character
        self._forget()

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces at one end of a token, each with the rank of the merge that takes it up."""
        out, limit = [], float("inf")
        while token:
            out.append((token, limit))
            if token not in self.parts:
                break
            limit = self.made[token]
            token = self.parts[token][side]
        return out

    def _apart(self, a: str, b: str, until: float = float("inf")) -> bool:
        """Whether no merge before `until` joins pieces of tokens a and b that stand together."""
        if a not in self.right:
            self.right[a] = self._edge(a, 1)
        if b not in self.left:
            self.left[b] = self._edge(b, 0)
        rank = self.rank
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < x_gone and r <= y_gone and r < until:
                    return False
        return True

    def _grow(self, word: str, last: list, n: list[int], closed: list[int]) -> None:
        """Extends what is known of a word's first bytes to the whole word: what fits after them and their count inside a longer word, and their count as a word of their own."""
        pairs, known, inside, whole = self.pairs, len(n) - 1, 0, 0
        for end, (size, is_open, close) in self.tokens.iter(word, max(0, known + 1 - self.longest)):
            if end < known:
                continue
            if end > known:
                break
            i = end + 1 - size
            if is_open and not inside and (i == 0 or last[i][is_open]):
                inside, here = n[i] + 1, is_open
            if close and not whole and (i == 0 or last[i][close]):
                whole = n[i] + 1
            if inside and whole:
                if (after := pairs.get(here)) is None:
                    after = pairs[here] = _After(self, here)
                last.append(after)
                n.append(inside)
                closed.append(whole)
                known, inside, whole = known + 1, 0, 0
        if known < len(word):
            raise ValueError(f"no encoding of {word!r}")

    def _learn_words(self, words: list[str]) -> None:
        """Keeps the steps of the counts by characters of words in letters for bytes; what words have in common at their start is gone through once."""
        last, n, closed, held = [None], [0], [0], ""
        for word in sorted(words):
            k, most = 0, min(len(word), len(held))
            while k < most and word[k] == held[k]:
                k += 1
            del last[k + 1 :], n[k + 1 :], closed[k + 1 :]
            self._grow(word, last, n, closed)
            held = word
            at = closed if word.isascii() else [0, *(closed[i] for i in range(1, len(word)) if word[i] not in self.inner), closed[-1]]
            self.words[word] = array("h", map(sub, at[1:], at)).tobytes()

    def _forget(self) -> None:
        """Sets aside what is kept, but for the endings of three characters, whose first two are two words."""
        self.known, self.words, self.aside = {"": b"\0\0"}, {}, self.words
        self._learn_words(["'", "r", "v", "l", *_LONG_ENDINGS])
        for w in _LONG_ENDINGS:
            first, whole = self._last_of("'"), self._last_of(w)
            both = first + self._last_of(w[1])
            self.words[w] = array("h", [first, both - first, whole - both]).tobytes()

    def _last_of(self, word: str) -> int:
        return sum(array("h", self.words[word]))

    def word(self, word: str) -> np.ndarray:
        """The counts after each character of a word in letters for bytes."""
        if word not in self.words:
            self._learn_words([word])
        return np.cumsum(np.frombuffer(self.words[word], "<i2"), dtype=np.int64)

    def _pieces(self, text: str) -> list[tuple[str, int, int]]:
        """The words of normalised text in letters for bytes, with start and end."""
        if _PLAIN.fullmatch(text):
            return [(m.group(), *m.span()) for m in _CUT.finditer(text)]
        return [(w, *at) for w, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _normal(self, text: str) -> str:
        return text.lower() if _PLAIN.fullmatch(text) else self.tokenizer.normalizer.normalize_str(text)

    def _straight(self, text: str) -> np.ndarray:
        """The counts after 0, 1, ... characters of normalised text."""
        out, before, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for word, a, b in self._pieces(text):
            out[at + 1 : a + 1] = before
            out[a + 1 : b + 1] = self.word(word) + before
            at, before = b, int(out[b])
        out[at + 1 :] = before
        return out

    def _ordinary(self, text: str) -> np.ndarray:
        """The counts after 0, 1, ... characters of a text without special strings."""
        plain = self._normal(text)
        if plain == "".join(map(str.lower, text)) and len(plain) == len(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._straight(plain)
        # characters that the normaliser joins, cuts or drops: each prefix of such a group is put after the whole groups before it
        joins = _joins_before()
        cuts = [0, *(i for i in range(1, len(text)) if not unicodedata.combining(text[i]) and text[i] not in joins), len(text)]
        groups = [self._normal(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        whole = "".join(groups)
        straight = self._straight(whole)
        starts = np.array([0, *(a for _, a, _ in self._pieces(whole))])
        out, done = np.zeros(len(text) + 1, np.int64), 0
        word, last, n, closed = "", [None], [0], [0]
        for a, b, group in zip(cuts, cuts[1:], groups, strict=False):
            for i in range(a + 1, b):
                k = max(0, int(np.searchsorted(starts, done, "left")) - 1)
                k -= k > 0 and whole[starts[k - 1] : starts[k]] == "'"  # it may be the start of an ending
                tail = whole[starts[k] : done] + self._normal(text[a:i])
                total = int(straight[starts[k]])
                for j, (w, x, y) in enumerate(pieces := self._pieces(tail)):
                    if j == 0 and w not in _LONG_ENDINGS:  # the one that goes on from group to group
                        if not w.startswith(word):
                            word = ""
                        del last[len(word) + 1 :], n[len(word) + 1 :], closed[len(word) + 1 :]
                        self._grow(w, last, n, closed)
                        total += closed[-1]
                        keep = len(whole[starts[k] + x : done].encode()) if len(pieces) == 1 else 0
                        word = w[: max(keep, len(word))]
                    else:
                        total += int(self.word(w)[-1])
                out[i] = total
            done += len(group)
            out[b] = straight[done]
        return out

    def counts(self, text: str) -> np.ndarray:
        """The exact token counts of text[:0], text[:1], ..., text."""
        if not self.marked(text):
            return self._ordinary(text)
        out, before, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for m in self.special.finditer(text):
            held = self._ordinary(text[at : m.end()])  # a special string is ordinary text until it is complete
            out[at : m.end() + 1] = held + before
            before += int(held[m.start() - at]) + 1
            out[m.end()] = before
            at = m.end()
        out[at:] = self._ordinary(text[at:]) + before
        return out

    def _learn(self, new: list[str]) -> None:
        """Keeps the steps of stretches without blanks, with two bytes for the blank after them."""
        cut: dict[str, list[str]] = {}
        other = []
        for s in new:
            if self.marked(s):
                self.known[s] = self._steps_of(s)
            elif _PLAIN.fullmatch(s):
                cut[s] = _CUT.findall(s.lower())
            else:
                other.append(s)
        for i in range(0, len(other), 1000):  # the tokenizer's own parts take many at once
            part = other[i : i + 1000]
            normal = self._normal(" ".join(part)).split(" ")
            same = [len(normal) == len(part) and s.isprintable() and n == "".join(map(str.lower, s)) and len(n) == len(s) and unicodedata.is_normalized("NFC", s) for s, n in zip(part, normal + part, strict=False)]
            for s, alike in zip(part, same, strict=True):
                if not alike:
                    self.known[s] = self._steps_of(s)
            part = [s for s, alike in zip(part, same, strict=True) if alike]
            texts = [n for n, alike in zip(normal, same, strict=False) if alike]
            ends, at = list(accumulate(len(t) + 1 for t in texts)), 0
            for s in part:
                cut[s] = []
            for word, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(texts)):
                while end > ends[at]:
                    at += 1
                cut[part[at]].append(word)
        words = self.words
        missing = {w for ws in cut.values() for w in ws if w not in words}
        words.update((w, self.aside[w]) for w in missing if w in self.aside)
        self._learn_words([w for w in missing if w not in words])
        for s, ws in cut.items():
            steps = b"".join(map(words.__getitem__, ws))
            self.known[s] = steps + b"\0\0" if len(steps) == 2 * len(s) else self._steps_of(s)

    def _steps_of(self, stretch: str) -> bytes:
        return array("h", np.diff(self.counts(stretch)).tolist()).tobytes() + b"\0\0"

    def steps_all(self, texts: list[str]) -> list[bytes]:
        """For each text the differences of counts(text), 2 bytes each; a difference that they can't hold is an error."""
        if len(self.known) > KEPT_WORDS or len(self.words) > KEPT_WORDS:
            self._forget()
        if self.n_pairs > KEPT_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        if new := {p for parts in cut for p in parts if p not in known}:
            self._learn([*new])
        return [b"".join(map(known.__getitem__, parts))[:-2] for parts in cut]

    def steps(self, text: str) -> bytes:
        return self.steps_all([text])[0]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """This worker's counter for the tokenizer at `path`."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Stores the token count of every prefix of every text, in code points; nothing is shuffled.

    A row holds `chunk` prefixes of one text: start (characters before them), base
    (the count there), least (the smallest count in it), steps (the differences
    of the counts, 2 bytes each), last (whether the text ends in it), and of its
    document row_id (a number of its own), doc_id, n_bytes, n_chars and
    n_tokens. A null text counts as empty and has one row without steps; rows
    that are repeated, or lack a doc_id, are counted each by itself; columns
    beyond doc_id and text are not read.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in small_parts(batches):
            out: list[tuple] = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for row, doc, text, steps in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), texts, count.steps_all(texts), strict=True):
                after, base = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64), 0
                told = (row, doc, len(text.encode()), len(text), int(after[-1]) if len(after) else 0)
                for k in range(0, max(len(text), 1), chunk):
                    held = after[k : k + chunk]
                    out.append((*told, k, base, int(min(base, held.min())) if len(held) else 0, k + chunk >= len(text), steps[2 * k : 2 * (k + chunk)]))
                    base = int(held[-1]) if len(held) else 0
                if len(out) > 512:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, _PREFIXES), "prefixes")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    names, types = zip(*(x.split(" ") for x in _PREFIXES.split(", ")), strict=True)
    values = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, t in zip(values, types, strict=True)], list(names))


def totals(prefixes: DataFrame) -> DataFrame:
    """row_id, doc_id, n_bytes, n_chars, n_tokens: one row for each row that was counted. No counts are read."""
    return prefixes.filter("last").select("row_id", "doc_id", "n_bytes", "n_chars", "n_tokens")


def longest_prefixes(prefixes: DataFrame, limit: int | Column) -> DataFrame:
    """row_id, doc_id, kept_chars, kept_tokens: the longest prefix of at most `limit` tokens (a number, or a column of `prefixes`; null: no limit).

    A longer prefix can have fewer tokens than a shorter one, so the last prefix
    that fits counts. A limit below 0 is fitted by none: null. Only stored rows
    that hold a prefix that fits are opened, and of texts that fit as a whole none.
    """
    asked = prefixes.withColumn("limit_", (limit if isinstance(limit, Column) else F.lit(limit)).cast("long"))

    def last_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, tokens = [], []
            for start, base, limit_, steps in zip(*(b.column(c).to_pylist() for c in ("start", "base", "limit_", "steps")), strict=True):
                after = base + np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)])
                k = int(np.flatnonzero(after <= limit_)[-1])
                chars.append(start + k)
                tokens.append(int(after[k]))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], ["row_id", "kept_chars", "kept_tokens"])

    over = asked.filter("n_tokens > limit_ and least <= limit_").select("row_id", "start", "base", "limit_", "steps")
    cut = over.mapInArrow(last_fit, "row_id long, kept_chars long, kept_tokens long").groupBy("row_id").agg(F.max(F.struct("kept_chars", "kept_tokens")).alias("kept"))
    ends = asked.filter("last").select("row_id", "doc_id", "n_chars", "n_tokens", "limit_")
    whole = F.col("limit_").isNull() | (F.col("n_tokens") <= F.col("limit_"))
    return ends.join(small_ids(cut), "row_id", "left").select(
        "row_id", "doc_id", F.when(whole, F.col("n_chars")).otherwise(F.col("kept.kept_chars")).alias("kept_chars"), F.when(whole, F.col("n_tokens")).otherwise(F.col("kept.kept_tokens")).alias("kept_tokens")
    )


def counts_at(prefixes: DataFrame, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of `asked` (doc_id, n_chars) with n_tokens, the count of the first n_chars characters of each text of that doc_id.

    Places before a text or beyond it, and null ones, have null; a doc_id without text, or null, gives no row.
    """
    asked = asked.select(F.col("doc_id").alias("asked_id"), F.col("n_chars").cast("long").alias("place"))
    at = F.greatest(F.floor((F.col("place") - 1) / chunk), F.lit(0)) * chunk
    found = prefixes.join(asked, F.col("doc_id") == F.col("asked_id")).filter(F.coalesce(F.least(at, F.floor((F.greatest("n_chars", F.lit(1)) - 1) / chunk) * chunk), F.lit(0)) == F.col("start"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for start, base, n_chars, place, steps in zip(*(b.column(c).to_pylist() for c in ("start", "base", "n_chars", "place", "steps")), strict=True):
                inside = place is not None and 0 <= place <= n_chars
                out.append(base + int(np.frombuffer(steps, "<i2")[: place - start].sum(dtype=np.int64)) if inside else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(out, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return found.select("doc_id", "start", "base", "n_chars", "place", "steps").mapInArrow(count, "doc_id long, n_chars long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and kept_chars: the characters of the longest prefix within `limit`, all from the stored prefixes.

    One row for each row of docs, also repeated ones and those without doc_id.
    A null text counts as empty: 0 bytes, 0 tokens. An empty table gives no rows.
    """
    prefixes = prefix_counts(docs, tokenizer)
    kept = longest_prefixes(prefixes, limit).select("row_id", "kept_chars")
    return totals(prefixes).join(kept, "row_id").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")

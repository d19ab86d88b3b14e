"""Token ids of whole texts with a public tokenizer."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np

END_ID = 2
#: A worker sets its words aside when there are more; those that it meets again it need not encode again.
KEPT_WORDS = 300_000

_coders: dict[str, WordCoder] = {}
#: A run of ASCII punctuation, but for the apostrophe, that ends a word: the tokenizer splits there anyway.
_PUNCTUATION = re.compile(r"(?<=[A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)(?![^ \n])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Encodes texts with a tokenizer that drops white space and never joins across it, each different word once.

    Ids are kept per stretch between blanks, in two generations of bounded size;
    what is forgotten is only encoded again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        sample = ["Two  Words", "two words", "two\nwords", "two words "]
        whole, *others = ([*e.ids] for e in self.tokenizer.encode_batch(sample, add_special_tokens=False))
        apart = [i for e in self.tokenizer.encode_batch(["two", "words"], add_special_tokens=False) for i in e.ids]
        if any(x != whole for x in (*others, apart)):
            raise ValueError(f"{path}: the tokenizer has upper case, keeps white space or joins across it")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.aside: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        known = self.known
        known.update((w, self.aside[w]) for w in new if w in self.aside)
        new = [w for w in new if w not in known]
        other = [w for w in new if not w.isalpha()]
        plain = [w for w in new if w.isalpha()]
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = self._ids([" ".join(part)])[0]
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(stops) == len(part):  # a word of letters alone ends in one id of a word's end
                held, stops = ids.tobytes(), stops.tolist()
                known.update(zip(part, map(held.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                other += part
        known.update(zip(other, (x.tobytes() for x in self._ids(other)), strict=True))

    def _parts(self, text: str) -> list[str]:
        if "<|" not in text:  # else it may hold a special string, which must stay as it is
            if text.isascii():
                text = text.lower()  # the tokenizer has lower case alone
            text = _PUNCTUATION.sub(r" \1", text)
        return text.replace("\n", " ").split(" ")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with END_ID after them."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.aside = {"": b""}, self.known
        cut = [self._parts(t) for t in texts]
        known = self.known
        if new := {w for parts in cut for w in parts if w not in known}:
            self._learn(sorted(new))
        end = np.array([END_ID], self.dtype).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)) + end, self.dtype) for parts in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def coder(path: str) -> WordCoder:
    """This worker's coder for the tokenizer at `path`."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def small_parts(batches: Iterator, rows: int = 256) -> Iterator:
    """Record batches cut into parts of at most `rows` rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)

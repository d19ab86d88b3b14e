"""First-fit decreasing packing of token sequences in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import keyed, named, stored, texts
from factorloom.llm.tokens import coder, default_tokenizer, small_parts

CAPACITY = 4096
#: Documents in a group, on average: enough that its last, half-empty sequence does not count.
GROUP_DOCS = 1024

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """The documents' ids, cut into pieces of at most `capacity`: doc_id, start, length, ids_crc32, doc_tokens and ids (little-endian unsigned 32-bit; null unless `with_ids`).

    Each document ends with the end id, so a null or empty text is one piece of
    length 1.
    """
    path = tokenizer or default_tokenizer()
    types = (*(pa.int64(),) * 5, pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in small_parts(batches):
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), code.encode_all(b.column("text").to_pylist()), strict=True):
                for i in range(0, len(ids), capacity):
                    p = ids[i : i + capacity].astype("<u4").tobytes()
                    out.append((doc, i, len(p) // 4, zlib.crc32(p), len(ids), p if with_ids else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return texts(docs).mapInArrow(cut, _PIECE)


def first_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in order, by first fit: a tournament tree holds the largest room below each node.

    The leaves are bins; each item goes down to the leftmost leaf with room for it.
    """
    lengths = list(lengths)
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        if n > capacity:
            raise ValueError(f"an item of {n} is longer than the capacity of {capacity}")
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= n
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(items: DataFrame, n_docs: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """The rows of items (doc_id, start, length, row and more) with sequence_id and offset, without row.

    `row` is a number of each row's own; items must be stored with it.

    Documents are dealt by a seeded hash to groups of about `group_docs`, pieces
    without doc_id one by one by `row`; in each group the pieces, longest first
    (ties by doc_id, start and row), go to the first sequence with room, so that a
    task that runs again places them alike. A group holds a bounded number of documents, whatever the
    input, and sequence_id is the group's number times 2^32 plus the sequence's.
    """
    groups = max(1, -(-n_docs // group_docs))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True])
        bins, offsets = first_fit(rows["length"].tolist(), capacity)
        return rows.assign(sequence_id=rows["pack_group"].astype("int64") * (1 << 32) + np.array(bins, "int64"), offset=np.array(offsets, "int64")).drop(columns=["pack_group", "row"])

    dealt = keyed(items.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", "row")), F.lit(groups))))  # pandas has no null of type long
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes if n != "row") + ", sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(fill, schema).withColumn("doc_id", named())


def packed_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Where every piece of every document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only lengths and checksums are shuffled; sequences() brings ids and places
    together. A null text counts as empty. Rows that share a doc_id are packed each
    time, in one group; rows without one each time, spread over all groups. An empty table gives no rows;
    columns beyond doc_id and text are not read.
    """
    kept = stored(pieces(docs, capacity, tokenizer, with_ids=False).drop("ids").withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(kept, kept.filter("start = 0").count(), capacity)


def sequences(placed: DataFrame, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens and ids (padded with 0 to `capacity`) from packed_pieces() and pieces() of the same documents."""
    full = placed.join(cut.select("doc_id", "start", "ids"), ["doc_id", "start"])
    bound = full.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    body = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return bound.select("sequence_id", "n_tokens", F.unhex(F.rpad(body, 8 * capacity, "0")).alias("ids"))

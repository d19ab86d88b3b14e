"""Near-duplicate detection with DartMinHash signatures and a banded join.

Every shingle of a document owns a strip of the plane, as wide as its weight.
Hashed darts fall on the strips at a constant rate per area, the same ones in
every document, and the signature keeps for each coordinate the dart that comes
first. Strips are cut into regions [0, 1), [1, 2), [2, 4), ... of weight; in a
region the darts come one after the other with exponential gaps, so documents
that look further only see more of the same darts. Two signatures agree in a
coordinate with the chance of the weighted Jaccard similarity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, once, small_ids, stored, texts
from factorloom.llm.components import components
from factorloom.llm.tokens import small_parts

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Times that the members of an undecided bucket are compared with others of them, HEADS each time, before they are compared by rare shingles.
HEAD_TURNS, HEADS = 1, 6

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_known: dict[str, int] = {}

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    words = _WORD.findall(text.encode("utf-8", "replace").lower().decode())  # of bytes, ASCII letters alone change
    if len(_known) > 200_000:
        _known.clear()
    for w in [w for w in words if w not in _known]:
        _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of `size` words and how often each occurs; a shorter text is one shingle."""
    if not len(words):
        return words, np.zeros(0, int)
    n = max(len(words) - size + 1, 1)
    h = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        h = mix(h * _GOLD + words[k : k + n])
    return np.unique(h, return_counts=True)


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each weighted set (elements' hashes, weights), none empty, the identities of the earliest darts of k coordinates."""
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(float)
    until = (np.log(k) + 2) * k / np.bincount(owner, weights, len(sets))
    out, todo = np.zeros((len(sets), k), np.uint64), np.arange(len(sets))
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < len(sets) else slice(None)
        best, name = _earliest(owner[mine], elements[mine], weights[mine], until, len(sets), k)
        out[todo] = name[todo]
        todo = todo[np.isinf(best[todo]).any(axis=1)]
        until[todo] *= 2  # some coordinate has no dart yet
    return out


def _earliest(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, until: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank and identity of the first dart of every set and coordinate, of the darts that come before the set's `until`."""
    parts = []  # of each region of each strip: its owner, its hash, how far the strip reaches into it, its width
    low, high, live = 0, 1, np.arange(len(elements))
    while len(live):
        parts.append((owner[live], mix(elements[live] + np.array([low * 2], np.uint64) * _GOLD), np.minimum(weights[live], high) - low, np.full(len(live), float(high - low))))
        live = live[weights[live] > high]
        low, high = high, high * 2
    doc, seed, reach, width = map(np.concatenate, zip(*parts, strict=True))
    limit, time, step, thrown = until[doc], np.zeros(len(seed)), np.zeros(1, np.uint64), []
    unit = 1 / float(1 << 53)
    while len(seed):
        step = step + _GOLD
        x = mix(seed + step)
        time = time - np.log(((x >> np.uint64(11)) + 0.5) * unit) / width
        soon = time < limit
        doc, seed, reach, width, limit, time, x = (v[soon] for v in (doc, seed, reach, width, limit, time, x))
        place = mix(x ^ _M2)
        hit = (place >> np.uint64(11)) * unit * width < reach
        thrown.append((doc[hit], time[hit], mix(x[hit] + _M1)))
    doc, rank, dart = map(np.concatenate, zip(*thrown, strict=True))
    at = doc * k + (dart % np.uint64(k)).astype(np.int64)
    best, name = np.full(n * k, np.inf), np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, at, rank)
    first = rank == best[at]
    np.minimum.at(name, at[first], dart[first])
    return best.reshape(n, k), name.reshape(n, k)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """doc_id, same (a digest that documents with the same shingles share), bands (a hash for each; none without words) and shingles (sorted 32-bit hashes, as bytes).

    Every shingle weighs 1, however often it occurs, as similarity is decided for
    sets: pairs whose repeated lines differ in number meet as often as others.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for b in small_parts(batches):
            held = b.column("text").to_pylist()
            sets = [shingles(word_hashes(t), size) for t in held]
            some = [k for k, (s, _) in enumerate(sets) if len(s)]
            bands_of: list[list[int]] = [[] for _ in held]
            if some:
                darts = dart_minhash([(sets[k][0], np.ones(len(sets[k][0]))) for k in some], bands * rows).reshape(len(some), bands, rows)
                h = salt
                for r in range(rows):
                    h = mix(h + darts[:, :, r])
                for k, row in zip(some, h.view(np.int64).tolist(), strict=True):
                    bands_of[k] = row
            same = [b"s" + xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"t" + xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for (s, _), t in zip(sets, held, strict=True)]
            packed = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s, _ in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(same, pa.binary()), pa.array(bands_of, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["doc_id", "same", "bands", "shingles"])
        _known.clear()  # workers go on to other tasks

    return texts(docs).mapInArrow(sign, "doc_id long, same binary, bands array<long>, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.concatenate([x, y])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n / max(len(x) + len(y) - n, 1)


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The different rows of pairs (a, b and more) whose sets of shingles have at least the similarity `threshold`, which is computed exactly.

    sets: doc_id, shingles. Both sides are joined with the same shuffle of the
    sets, also where few pairs could be broadcast, so that the plan is the same at
    every size; Spark splits the shuffled rows of a document in very many pairs.
    """
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set"))
    near = F.least(F.length("a_set"), F.length("b_set")) >= threshold * F.greatest(F.length("a_set"), F.length("b_set"))

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    both = pairs.distinct().hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return both.filter(near).filter(share("a_set", "b_set") >= threshold).select(pairs.columns)


def _undecided(crowded: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """band, doc_id, grp for the members of buckets that hold documents of several components."""
    known = groups.withColumnRenamed("node", "doc_id")
    members = scratch.store(crowded.select("band", "doc_id").join(known, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("grp")), "members")
    mixed = members.groupBy("band").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low != high").select("band")
    return scratch.store(members.join(scratch.store(mixed, "mixed"), "band"), "undecided")


def _rare_pairs(undecided: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, and their components x, y) of undecided documents in different components that may be similar enough.

    Similar sets of n and m shingles have need(n, m) in common, so in any fixed
    order they share one among the first n - need + 1 and m - need + 1. The order
    here is from rare to frequent: what a document alone has comes first, and
    copies that differ in much meet nowhere. Need grows with the smaller set's
    size, so rows are keyed by its class of size (steps of 2 %). Shingles of one
    component alone join nothing and are left out once they are counted; of the
    members of a key, those of its largest component aren't compared.
    """
    step = math.log(1.02)
    size_class = lambda n: F.floor(F.log(n) / step)
    need = lambda n, m: F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches, 16):
            held = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in held])
            again = lambda v: pa.array(np.repeat(np.asarray(v), sizes))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([again(b.column("doc_id")), again(b.column("grp")), again(b.column("text")), again(sizes), pa.array(np.concatenate(held))], ["doc_id", "grp", "text", "n", "shingle"])

    members = scratch.store(undecided.select("doc_id", "grp").distinct(), "members")
    each = scratch.store(sets.join(members.hint("merge"), "doc_id").select("doc_id", "grp", F.xxhash64("shingles").alias("text"), "shingles").mapInArrow(unpack, "doc_id long, grp long, text long, n long, shingle long"), "each")
    often = scratch.store(each.groupBy("shingle").agg(F.count("*").alias("often"), (F.min("grp") != F.max("grp")).alias("mixed")), "often")
    place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("often", "shingle"))
    n = F.col("n")
    as_smaller = F.struct(size_class(n).alias("size"), F.lit(False).alias("larger"), (n - need(n, n) + 1).alias("until"))
    as_larger = F.transform(
        F.sequence(size_class(threshold * n), size_class(n)),
        lambda c: F.struct(c.alias("size"), F.lit(True).alias("larger"), (n - need(F.greatest(F.exp(c * step) - 1e-6, threshold * n), n) + 1).alias("until")),
    )
    ranked = each.join(often, "shingle").withColumn("place", place).filter("mixed").filter(F.col("place") <= n - F.ceil(threshold * n - 1e-9) + 1)
    roles = F.filter(F.concat(F.array(as_smaller), as_larger), lambda r: F.col("place") <= r["until"])
    key = ["shingle", "size"]
    first = scratch.store(ranked.withColumn("role", F.explode(roles)).select("shingle", "role.size", "role.larger", "doc_id", "grp", "n", "place"), "first")
    held = first.groupBy(*key, "grp").agg(F.count("*").alias("rows"))
    top = held.groupBy(key).agg(F.max_by("grp", F.struct("rows", "grp")).alias("top"), F.count("*").alias("groups")).filter("groups > 1").select(*key, "top")
    left = scratch.store(first.join(scratch.store(top, "top"), key).filter("grp != top").drop("top"), "left")
    right = first.select(*key, (~F.col("larger")).alias("larger"), F.col("doc_id").alias("b"), F.col("grp").alias("other"), F.col("n").alias("m"), F.col("place").alias("there"))
    enough = F.least(n - F.col("place"), F.col("m") - F.col("there")) + 1 >= need(n, F.col("m"))
    found = left.join(right, [*key, "larger"]).filter("grp != other").filter(enough)
    swapped = F.col("doc_id") < F.col("b")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    return found.select(pick("doc_id", "b").alias("a"), pick("b", "doc_id").alias("b"), pick("grp", "other").alias("x"), pick("other", "grp").alias("y"))


def _grown(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """groups (node, component) after the components x and y of links are joined."""
    up = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    moved = groups.join(up.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return scratch.store(moved.select("node", F.coalesce("to", "component").alias("component")).union(up.select("node", "component")).distinct(), "groups")


def _groups(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id and same of every document, and same, first (smallest doc_id) and component (doc_id) of each different set of shingles."""
    with Scratch(docs.sparkSession, "minhash") as scratch:
        signed = scratch.store(signatures(docs.filter(F.col("doc_id").isNotNull()), bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
        one = scratch.store(signed.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("lead"), F.first("bands").alias("bands")).select("same", F.col("lead.doc_id").alias("first"), "lead.row", "bands"), "one")
        placed = one.select(F.col("first").alias("doc_id"), "row", F.explode("bands").alias("band"))
        buckets = scratch.store(placed.groupBy("band").agg(F.min("doc_id").alias("head"), F.min("row") != F.max("row")).toDF("band", "head", "shared").filter("shared").drop("shared"), "buckets")
        crowded = scratch.store(placed.join(buckets, "band"), "crowded")
        sets = scratch.store(signed.select("doc_id", "row", "shingles").join(crowded.select("row").distinct().hint("merge"), "row", "left_semi").select("doc_id", "shingles"), "sets")
        links = scratch.store(similar(crowded.filter("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")), sets, threshold), "links")
        groups = components(links, scratch)
        for turn in range(HEAD_TURNS + 1):
            undecided = _undecided(crowded, groups, scratch)
            if undecided.isEmpty():
                break
            if turn < HEAD_TURNS:
                drawn = [F.min_by(F.struct("doc_id", "grp"), F.xxhash64("doc_id", "band", F.lit(HEADS * turn + k))) for k in range(HEADS)]
                heads = scratch.store(undecided.groupBy("band").agg(F.array_distinct(F.array(*drawn)).alias("heads")), "heads")
                met = undecided.join(heads, "band").select("doc_id", "grp", F.explode("heads").alias("head")).filter("grp != head.grp")
                pairs = met.select(F.greatest("doc_id", "head.doc_id").alias("a"), F.least("doc_id", "head.doc_id").alias("b"), F.col("grp").alias("x"), F.col("head.grp").alias("y"))
            else:
                pairs = _rare_pairs(undecided, sets, threshold, scratch)
            links = scratch.store(similar(pairs, sets, threshold), "links")
            if not links.isEmpty():
                groups = _grown(groups, links, scratch)
        known = one.select("same", "first").join(groups.withColumnRenamed("node", "first"), "first", "left")
        return stored(signed.select("doc_id", "same"), "members"), stored(known.select("same", "first", F.coalesce("component", "first").alias("component")), "groups")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), group_size and kept (that document).

    Documents with the same shingles are one from the start. In every band's
    bucket all members are compared with the smallest. Members of buckets that
    are then still in several components are compared with all members of other
    components with which they share one of their rarest shingles, as any two
    similar sets do (before that HEAD_TURNS times with HEADS others of their
    bucket): no candidate pair is left out that is similar and not joined by
    links already. Similarity is the exact Jaccard similarity of sets of
    five-word shingles.

    Texts without words are alike only if equal; null counts as empty. Rows
    repeated with their doc_id are returned each time, alike; rows of one doc_id
    with different texts each have the class of their text. A row without doc_id
    is in no group: class_id null, group_size 1, kept. An empty table gives no
    rows; columns beyond doc_id and text are not read.
    """
    members, groups = _groups(docs, threshold, bands, rows)
    classes = members.join(groups.select("same", F.col("component").alias("class_id")), "same").select("doc_id", "class_id")
    sizes = stored(classes.groupBy("class_id").agg(F.count("*").alias("group_size")), "sizes")
    named = classes.join(sizes, "class_id").select("doc_id", "class_id", "group_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    unnamed = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return named.union(unnamed)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near duplicates (the smallest doc_id), all their columns kept.

    Only the ids of documents that go are brought to the texts. Null texts count
    as empty; rows without doc_id stay; rows repeated with doc_id and text stay
    once; where rows of one doc_id have different texts, all stay if one does. An
    empty table stays empty.
    """
    members, groups = _groups(docs, SIMILARITY, BANDS, ROWS)
    named = members.join(groups.select("same", F.col("component").alias("class_id")), "same")
    gone = stored(named.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("class_id")).alias("kept")).filter("not kept").select("doc_id"), "gone")
    return once(docs.join(small_ids(gone), "doc_id", "left_anti").select(docs.columns))

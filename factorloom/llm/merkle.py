"""A Merkle manifest of documents: a tree for each language, and one over their roots.

Nodes are numbered in their order by ranges, cut into aligned blocks, and each
block is gone through in postorder: a call returns the digest of its subtree, and
while calls return, each appends the other half's digest to the leaves that it
holds. The roots of the blocks are the nodes of the next traversal, so a tree of
any size takes log(n) / log(block) rounds of tasks of bounded size.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, small, stored

#: A block has 2 to this power nodes.
LEVELS = 12


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(source: Column, n_chars: Column) -> Column:
    """The digest of a document: each field as its byte count, a colon and the value, or - if null."""
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), source, F.col("lang"), n_chars, F.col("text")))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, and the leaf with n_chars one higher where 7 divides the CRC-32 of doc_id; null where nothing is changed."""
    n_chars = F.col("n_chars")
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & n_chars.isNotNull()
    return docs.select("lang", "doc_id", leaf(F.col("source"), n_chars).alias("leaf"), F.when(changed, leaf(F.col("source"), F.try_add(n_chars.cast("long"), F.lit(1)))).alias("tampered"))


def numbered(nodes: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """nodes with position (from 0) in their group and n, the group's size; nulls come first.

    Rows are dealt and sorted by ranges of (group, order), stored, and numbered
    within their part; only one row for each part and group is summed up in a window.
    """
    keys = [group, *order]
    ranged = scratch.store(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id_", F.monotonically_increasing_id()), "sorted")
    ranged = ranged.withColumn("part_", F.shiftright("id_", 33))
    held = ranged.groupBy(group, "part_").agg(F.min("id_").alias("first_"), F.count("*").alias("rows_"))
    ahead, whole = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    held = scratch.store(held.select(F.col(group).alias("group_"), F.col("part_").alias("at_"), "first_", F.coalesce(F.sum("rows_").over(ahead), F.lit(0)).alias("before_"), F.sum("rows_").over(whole).alias("n")), "parts")
    found = ranged.join(small(held), F.col(group).eqNullSafe(F.col("group_")) & (F.col("part_") == F.col("at_")))
    return found.select(*nodes.columns, (F.col("before_") + F.col("id_") - F.col("first_")).alias("position"), "n")


def traversed(digests: list[str], levels: int) -> tuple[str, list[list[str | None]]]:
    """The digest over consecutive nodes, `levels` levels up, and each node's siblings on the way, None where it has none."""
    siblings: list[list[str | None]] = [[] for _ in digests]

    def climb(first: int, level: int) -> str:
        if level == 0:
            return digests[first]
        middle = first + (1 << (level - 1))
        end = middle + (1 << (level - 1))
        left = climb(first, level - 1)
        right = climb(middle, level - 1) if middle < len(digests) else None
        for other, half in ((right, siblings[first:middle]), (left, siblings[middle:end])):
            for s in half:
                s.append(other)
        return hashlib.sha256((left + (right or "")).encode()).hexdigest()

    return climb(0, levels), siblings


def blocks(nodes: DataFrame, group: str, levels: int = LEVELS) -> DataFrame:
    """nodes (group, position, n, digest) with siblings in their aligned block; the block's first node has its root as `top`, others null.

    In a group of several blocks each climbs `levels` levels, so that their roots
    are nodes of one level; in a group of one block as many as lead to one node.
    """

    def climb(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        n = table.column("n")[0].as_py()
        root, siblings = traversed(table.column("digest").to_pylist(), levels if n > 1 << levels else (n - 1).bit_length())
        return table.append_column("siblings", pa.array(siblings, pa.list_(pa.string()))).append_column("top", pa.array([root, *[None] * (len(siblings) - 1)], pa.string()))

    kind = dict(nodes.dtypes)[group]
    dealt = nodes.select(group, F.shiftright("position", levels).alias("block"), "position", "n", "digest")
    return dealt.groupBy(group, "block").applyInArrow(climb, f"{group} {kind}, block long, position long, n long, digest string, siblings array<string>, top string")


def paths(nodes: DataFrame, group: str, scratch: Scratch, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The traversals of all rounds, the nodes' first, and the groups' roots: group, digest."""
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rounds.append(scratch.store(blocks(nodes, group, levels), "blocks"))
        tops = rounds[-1].filter("top is not null")
        if most <= 1 << levels:
            return rounds, tops.select(group, F.col("top").alias("digest"))
        nodes = tops.select(group, F.col("block").alias("position"), F.shiftright(F.col("n") + ((1 << levels) - 1), levels).alias("n"), F.col("top").alias("digest"))
        most = -(-most >> levels)


def steps(siblings: str = "siblings") -> Column:
    """Siblings with the side on which they stand, by the bits of the node's position."""
    return F.transform(siblings, lambda s, i: F.struct(s.alias("digest"), (F.getbit(F.col("position"), i) == 1).alias("left")))


def joined_paths(rounds: list[DataFrame], group: str, above: DataFrame | None = None) -> DataFrame:
    """group, position, path of the first round's nodes: their steps up to the group's root, then those of `above` (group, path)."""
    last = None
    for held in reversed(rounds):
        own = held.select(group, "position", "block", steps().alias("path"))
        if last is None and above is None:
            last = own.select(group, "position", "path")
            continue
        if last is None:
            other = small(above.select(F.col(group).alias("group_"), F.col("path").alias("more_")))
            met = F.col(group).eqNullSafe(F.col("group_"))
        else:
            other = small(last.select(F.col(group).alias("group_"), F.col("position").alias("place_"), F.col("path").alias("more_")))
            met = F.col(group).eqNullSafe(F.col("group_")) & (F.col("block") == F.col("place_"))
        last = own.join(other, met).select(group, "position", F.concat("path", "more_").alias("path"))
    return last


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda a, s: F.sha2(F.when(s["digest"].isNull(), a).when(s["left"], F.concat(s["digest"], a)).otherwise(F.concat(a, s["digest"])), 256)
    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs.

    Within a language (null is one of its own) leaves stand by doc_id, null first;
    rows of one doc_id by their leaves. n_chars that can't be raised (null, or the
    largest long, which becomes null) and a null doc_id are no error. Columns
    beyond doc_id, source, lang, n_chars and text are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark, "merkle") as scratch:
        rows = scratch.store(leaves(docs), "leaves")
        named = scratch.store(numbered(rows, "lang", ["doc_id", "leaf"], scratch).withColumn("digest", F.col("leaf")), "numbered")
        rounds, subroots = paths(named, "lang", scratch, levels=levels)
        subroots = scratch.store(subroots.withColumn("all_", F.lit(0)), "subroots")
        heads = scratch.store(numbered(subroots, "all_", ["lang"], scratch), "heads")
        top_rounds, top = paths(heads, "all_", scratch, levels=levels)
        root = top.first()
        by_lang = heads.join(joined_paths(top_rounds, "all_"), ["all_", "position"]).select("lang", "path")
        by_lang = scratch.store(by_lang, "tops")
        way = joined_paths(rounds, "lang", by_lang).select(F.col("lang").alias("lang_"), F.col("position").alias("position_"), "path")
        found = named.join(way, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("position") == F.col("position_")))
        found = found.join(small(subroots.select(F.col("lang").alias("of_"), F.col("digest").alias("subroot"))), F.col("lang").eqNullSafe(F.col("of_")))
        whole = found.select(
            "doc_id", "leaf", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), F.sha2(F.array_join("path.digest", ""), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
        )
        return stored(whole.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")

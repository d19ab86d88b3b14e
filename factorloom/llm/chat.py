"""Chat formatting as a prefix tree of conversations.

A node is a turn after all turns before it; conversations that begin alike share
nodes. The path of a node, one digest for each of its turns, orders the forest:
a node sorts right before those below it, so sorting by path is the depth-first
walk and a running sum of lengths is the place of each node in the output. In that
order those who may attend to a node's characters are one interval: from its start
to the end of its subtree. So every node has one interval, however deep it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import parts_for, small, stored

#: The template: control strings around a turn's role and text. They all begin with "<".
BEGIN, MIDDLE, END = "<s>", "<m>", "</s>"
#: Hexadecimal digits of a turn's digest in a path.
_STEP = 24


#: What stands for the characters with which control strings, here and in common templates, begin; the backslash comes first.
_ESCAPES = (("\\", r"\e"), ("<", r"\l"), ("[", r"\b"))


def escape(text: Column) -> Column:
    """A text in which no control string can stand, for their first characters are spelled otherwise."""
    for char, spelled in _ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(spelled))
    return text


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(role), F.lit(MIDDLE), escape(text), F.lit(END))


def unescaped(text: str) -> str:
    """A text before escape()."""
    for char, spelled in reversed(_ESCAPES):
        text = text.replace(spelled, char)
    return text


def parsed(turn: str) -> tuple[str, str]:
    """role and text, read back from a formatted turn."""
    role, text = turn[len(BEGIN) : len(turn) - len(END)].split(MIDDLE, 1)
    return unescaped(role), unescaped(text)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text, path, position (formatted characters before it in its conversation) and last (whether it ends there) for every turn; turns that tie are ordered by role and text.

    A conversation is put in order within its own group; null roles and texts
    count as empty.
    """
    turns = conversations.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("length", F.length(formatted(F.col("role"), F.col("text"))).cast("long"))
    digest = F.substring(F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256), 1, _STEP)
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    order = inside.rowsBetween(Window.unboundedPreceding, 0)
    steps = turns.select("conv_id", "role", "text", F.row_number().over(inside).alias("depth"), F.collect_list(digest).over(order).alias("steps"), (F.sum("length").over(order) - F.col("length")).alias("position"), F.lead(F.lit(1)).over(inside).isNull().alias("last"))
    return steps.select("conv_id", "depth", "role", "text", F.array_join("steps", "").alias("path"), "position", "last")


def _node(path: Column) -> Column:
    """16 bytes that stand for a path."""
    return F.unhex(F.md5(path))


def prefix_tree(turns: DataFrame) -> DataFrame:
    """The nodes of paths(): path, depth, turn (formatted), start and end of its characters in the output, until (the end of its subtree), position (characters before it in its conversations), last (whether a conversation ends with it) and range (the part of the output that it stands in); loss_start and loss_end, the place of an assistant's text in the output, are null elsewhere.

    Shared turns occur once. Places come from sums over ranges of paths, then
    within a range. A character's position id is `position` plus its place in the
    turn. It is seen by the characters after it up to `until`; the other way round
    it may attend to all nodes with start <= its own node's start < until, and to
    what is before it in its own turn. The end of a subtree is the end of the last
    of the turns in it with which conversations end, so each conversation tells its
    own turns where it ends: as many rows as turns.
    """
    node = F.struct("depth", "role", "text")
    ahead_of_text = F.length(escape(F.col("n.role"))) + len(BEGIN) + len(MIDDLE)
    nodes = turns.groupBy("path").agg(F.min(node).alias("n"), F.min("position").alias("position"), F.max("last").alias("last"))
    nodes = nodes.select("path", "n.depth", "position", "last", formatted(F.col("n.role"), F.col("n.text")).alias("turn"), F.when(F.col("n.role") == "assistant", ahead_of_text).alias("loss_from"))
    n = parts_for(turns)
    ranged = stored(nodes.repartitionByRange(n, "path").sortWithinPartitions("path").select("*", F.length("turn").cast("long").alias("length"), F.spark_partition_id().alias("range")), "nodes")
    inside = Window.partitionBy("range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("length").alias("total"))
    before = small(totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    placed = stored(ranged.withColumn("ahead", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(before, "range").withColumn("start", F.col("before") + F.col("ahead")).drop("before", "ahead").withColumn("node", _node(F.col("path"))), "placed")
    ends = placed.filter("last").select("node", (F.col("start") + F.col("length")).alias("end"))
    told = turns.select("conv_id", "last", _node(F.col("path")).alias("node"))
    closing = told.filter("last").join(ends, "node").select(F.col("conv_id").alias("closed"), "end")
    until = told.join(closing, F.col("conv_id").eqNullSafe(F.col("closed"))).groupBy("node").agg(F.max("end").alias("until"))
    end = F.col("start") + F.col("length")
    return placed.join(until, "node").select(
        "path", "depth", "turn", "start", end.alias("end"), "until", "position", "last", "range",
        (F.col("start") + F.col("loss_from")).alias("loss_start"), F.when(F.col("loss_from").isNotNull(), end - len(END)).alias("loss_end"),
    )


_READ = "node binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands at the last turns of conversations: the nodes whose intervals are open there, which lie on a stack while rows come by range and start."""
    stack: list[dict] = []
    at = None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if row["range"] != at:
                stack, at = [], row["range"]
            while stack and stack[-1]["until"] <= row["start"]:
                stack.pop()
            said, size = parsed(row["turn"]), row["end"] - row["start"]
            if size != len(row["turn"]):
                raise ValueError(f"a turn of {len(row['turn'])} characters has a place of {size}")
            from_, to = row["loss_start"], row["loss_end"]
            loss = "" if from_ is None else unescaped(row["turn"][from_ - row["start"] : to - row["start"]])
            stack.append({"until": row["until"], "said": f"{said[0]}\n{said[1]}\n", "loss": loss})
            if row["last"] and not row["carried"]:
                loss = "".join(x["loss"] for x in stack)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(x["said"] for x in stack), loss)]
                out.append((row["node"], len(stack), digests[0], len(loss), digests[1], row["position"] + size))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*out, strict=True) if out else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in _READ.split(", ")])


def read_back(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """The conversations in the tree: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    leaves has conv_id and the path of its last turn. A conversation is that turn
    and all nodes whose intervals hold its start; their characters are parsed in
    the order of their places. The loss is what stands between loss_start and
    loss_end, and the length is the last character's position id and 1. Ranges of
    the output are read in parallel; a node whose interval goes on beyond its range
    is also handed to each further range that it reaches into, so a range begins
    with at most one conversation's open turns. The ranges' bounds, a few numbers
    for each, are brought to the driver.
    """
    own = tree.select(_node(F.col("path")).alias("node"), "range", "turn", "start", "end", "until", "position", "last", "loss_start", "loss_end")
    bounds = {r["range"]: (r["low"], r["high"]) for r in own.groupBy("range").agg(F.min("start").alias("low"), F.max("end").alias("high")).collect()}
    rows = own.withColumn("carried", F.lit(False))
    if len(bounds) > 1:
        spark = tree.sparkSession
        ends = small(spark.createDataFrame([(k, high) for k, (_, high) in bounds.items()], "range int, high long"))
        later = F.array(*[F.struct(F.lit(k).alias("range"), F.lit(low).alias("low")) for k, (low, _) in sorted(bounds.items())])
        reaching = own.join(ends, "range").filter(F.col("until") > F.col("high"))
        targets = F.filter(later, lambda x: (x["range"] > F.col("range")) & (x["low"] < F.col("until")))
        carried = reaching.select("*", F.explode(F.transform(targets, lambda x: x["range"])).alias("to")).withColumn("range", F.col("to")).withColumn("carried", F.lit(True))
        rows = rows.unionByName(carried.select(rows.columns))
    read = rows.repartition("range").sortWithinPartitions("range", "start").mapInArrow(_conversations, _READ)
    return leaves.select("conv_id", _node(F.col("path")).alias("node")).join(read, "node").drop("node")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations formatted as one prefix tree and read back from it.

    An empty table gives no rows; columns beyond conv_id, turn, role and text are
    not read. Rows repeated within a conversation are turns of their own; rows
    without conv_id are one conversation; rows without turn come first in theirs.
    """
    turns = stored(paths(conversations), "paths")
    tree = stored(prefix_tree(turns), "tree")
    return read_back(tree, turns.filter("last").select("conv_id", "path"))

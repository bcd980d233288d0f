"""Prefix trie of conversations, built level by level with grouped joins.

A node is a distinct sequence of first turns, and is named by its depth and the smallest conversation that starts with
it. Level by level, the conversations that are still in company are grouped by (parent node, next turn), and each group
gets its smallest conversation as its name. A conversation that is alone in its group has no company further down
either: its other nodes form a chain and are written at once, so there are as many levels as the longest sequence that
two conversations share, not as the longest conversation. Levels are then joined upwards, children summed by parent, to
give every node its leaves and savings.

Turns are known by the SHA-256 of role and text: no text is shuffled. Hot nodes (a first turn that a third of all
conversations share) are summed before they are shuffled, and the join that takes the group's name back to its members
has one row a group on its other side, so Spark can split the hot one. What a level decides is written before the next
one reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, handing_back, materialize, new_path, small_batches, word_count

#: Conversations of a chunk of a node's ends: 2 to this power of consecutive identifiers at most.
CHUNK_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id long, pos, turn_id, words): every conversation's turns, numbered from 1 in the order of ``turn``, null first,
    equal ones by their digest; a null role or text is empty. Rows without a conversation belong to none.

    Rows are dealt by ranges of (conversation, turn, digest) and numbered where they lie, so a conversation of any length
    is numbered by many tasks; what goes through the driver is four numbers for each range.
    """
    spark = df.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    slim = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), turn_id(role, text).alias("turn_id"), word_count(text).alias("words"))
    slim = materialize(slim.where("conv_id IS NOT NULL"), "trie-slim")
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("turn_id")]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn_id", "words")
    out = T.StructType([*dealt.schema, T.StructField("local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done = None, 0
        for b in batches:
            conv = b.column(1).to_numpy()
            if not len(conv):
                continue
            first = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            local = np.arange(1, len(conv) + 1) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == before:
                local[: first[1] if len(first) > 1 else len(conv)] += done
            before, done = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=out.fieldNames())

    small_batches(spark)
    local = materialize(dealt.mapInArrow(number, out), "trie-numbered")
    edges = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), F.max(F.struct("conv_id", "local"))["local"].alias("n")).orderBy("part").collect()
    moved, high, n = [], None, 0  # the conversation that goes on in the next range, and how many turns it has had
    for e in edges:
        if e["low"] == high:
            moved.append((e["part"], e["low"], n))
        n = e["n"] + (n if e["low"] == high == e["high"] else 0)
        high = e["high"]
    shifts = spark.createDataFrame(moved, "part int, conv_id long, shift long")  # a row for each range at most
    met = local.join(F.broadcast(shifts), ["part", "conv_id"], "left")
    return met.select("conv_id", (F.col("local") + F.coalesce("shift", F.lit(0))).alias("pos"), "turn_id", "words")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node. turns: (conv_id, pos, turn_id, words, n_turns), pos from 1 to n_turns without a gap; convs:
    (conv_id, n_turns), those without turns too, each once.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved_tokens`` (summed over its subtree, each node's members but one
    times the words of its last turn), ``ends_sha256`` (of the members that end there, decimal, ascending, comma-joined).

    Defined cases: conversations without turns are members of the root alone, and end there; equal conversations share all
    their nodes; a conversation alone in the table makes a chain; without any conversation there are no nodes.
    """
    spark = turns.sparkSession
    small_batches(spark)
    top = new_path(spark, "trie")
    turns = materialize(turns.select("conv_id", "pos", "turn_id", "words", "n_turns").sortWithinPartitions("pos"), "", f"{top}/turns")  # a level reads its pages only
    convs = materialize(convs.select("conv_id", "n_turns"), "", f"{top}/convs")
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()

    # Downwards: nodes/depth=d has the groups, live/depth=d the conversations in groups of two or more.
    depth = 0
    live = convs.select("conv_id", F.lit(root["node"]).cast("long").alias("node"), "n_turns")
    while root["n"] and not live.isEmpty():
        depth += 1
        here = turns.where(F.col("pos") == depth)
        if depth == 1:
            at = here.withColumn("parent", F.lit(root["node"]).cast("long"))
        else:
            at = here.join(live.select("conv_id", F.col("node").alias("parent")), "conv_id")
        groups = at.groupBy("parent", "turn_id").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
        groups = materialize(groups, "", f"{top}/nodes/depth={depth}")
        shared = groups.where("n_convs > 1").select("parent", "turn_id", "node")
        live = materialize(at.join(shared, ["parent", "turn_id"]).select("conv_id", "node", "n_turns"), "", f"{top}/live/depth={depth}")

    # Upwards: rolled/depth=d has the same nodes with the sums of their subtrees.
    kids = None
    saving = (F.col("n_convs") - 1) * F.col("words")
    for d in range(depth, -1, -1):
        if d:
            groups = spark.read.schema(groups.schema).parquet(f"{top}/nodes/depth={d}")
            shared = groups.where("n_convs > 1").select("node", "parent", "n_convs", saving.alias("own"))
            alone = groups.where("n_convs = 1").select("node", "parent", "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        else:
            shared = convs.agg(F.min("conv_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("own")).where("n_convs > 0")
        if kids is None:
            none = F.lit(None).cast("long")
            met = shared.withColumns({"n_children": none, "n_leaves": none, "saved": none})
        else:
            met = shared.join(kids, F.col("node") == F.col("of"), "left")
        made = met.select(
            "node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("own") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        rolled = materialize(made.unionByName(alone) if d else made, "", f"{top}/rolled/depth={d}")
        kids = rolled.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))

    # All levels of one kind are one table, the level its partition.
    every = lambda kind, schema: spark.read.schema(T.StructType([*schema, T.StructField("depth", T.LongType())])).parquet(f"{top}/{kind}")
    ends = convs.where("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(root["node"]).cast("long").alias("node"), "conv_id")
    if depth:
        ends = ends.unionByName(every("live", live.schema).where("n_turns = depth").select("depth", "node", "conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = every("rolled", rolled.schema).join(digests(ends), ["depth", "node"], "left").where("depth = 0 OR n_convs > 1")
    nodes = nodes.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *names[3:7], F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    if not depth:
        return nodes
    one, zero, last = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("pos") == F.col("n_turns")
    starts = every("nodes", groups.schema).where("n_convs = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("start"), "parent")
    chains = turns.join(starts, "conv_id").where("pos >= start").select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return nodes.unionByName(chains)


def digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): chunks of bounded size are joined where they are grouped, then
    each node's chunks pass through one hash in order, without ever being held together."""
    chunk = F.call_function("shiftright", F.col("conv_id"), F.lit(CHUNK_BITS)).alias("chunk")
    listed = ends.groupBy("depth", "node", chunk).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = listed.repartition("depth", "node").sortWithinPartitions("depth", "node", "chunk").select("depth", "node", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made = None, None
        for b in batches:
            done: list[tuple] = []
            for depth, node, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, node) != key:
                    if key is not None:
                        done.append((*key, made.hexdigest()))
                    key, made = (depth, node), hashlib.sha256()
                else:
                    made.update(b",")
                made.update(ids.encode())
            yield _rows(done)
        if key is not None:
            yield _rows([(*key, made.hexdigest())])

    return ordered.mapInArrow(handing_back(run), columns(depth="long", node="long", ends_sha256="string"))


def _rows(done: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*done, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.string())], names=["depth", "node", "ends_sha256"])

"""Connected components: a forest inside each partition, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clauseframe.llm.common import columns, drop_table, materialize

#: Links that a task's forest holds before it is passed on.
FOREST_LINKS = 1_000_000
#: Links of a task, and tasks at least: the more links a forest has seen, the fewer rounds follow.
TASK_LINKS, LEAST_TASKS = 100_000, 4


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links (a, b), a link from each node to the smallest that this partition's links reach from it."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def flush() -> pa.RecordBatch:
        made = [(x, find(x)) for x in list(up)]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) >= FOREST_LINKS:
            yield flush()
    yield flush()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour on the smallest one: of a node's larger neighbours (large), or of it and its smaller ones."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all ends of the links (a, b), longs; the component is its smallest node.

    Each round is written to the shared folder. Links may repeat, point either way or to themselves. Rounds end when
    one changes nothing, which a star of each component's smallest node is the only state to allow. The links are
    counted first, so they should be a table that is written already.
    """

    def settle(links: DataFrame, n: int) -> tuple[DataFrame, dict]:
        seen = Observation()
        made = links.distinct().coalesce(max(LEAST_TASKS, n // TASK_LINKS)).mapInArrow(_forest, columns(a="long", b="long"))
        sums = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return materialize(made.observe(seen, *sums), "components"), seen.get

    now, before = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), edges.count())
    for _ in range(most_rounds):
        new, state = settle(_stars(_stars(now, True), False), before["n"])
        drop_table(now)
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

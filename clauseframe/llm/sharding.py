"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each source partition sends to each target follows the multivariate hypergeometric law of a uniform
random permutation. These counts are drawn first; then a partition permutes its rows and deals them out by its row
of the matrix, and each target permutes what it got. Targets are blocks of consecutive slots, of a bounded number
of rows, and a shard is a run of blocks, so a shard may be larger than what one task holds. No task ever sees the
whole matrix: the rows of the matrix are leaves of a binary tree over the sources, and a task draws only the path
to its own leaf, each node with its own random stream, so every task and every retry draws the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, materialize, small_batches

#: Rows of a block of slots at most: what one task sorts.
BLOCK_ROWS = 1 << 15
#: Blocks at most, for which blocks may be larger: a task draws a number for each block at each level of the tree.
MOST_BLOCKS = 1 << 16
#: Bytes of a block that are aimed at, at most: rows fall into blocks at random, so blocks have about the mean's multiple.
BLOCK_BYTES = 64 << 20
#: Above this many rows numpy has no hypergeometric draw; the sum below takes over.
NUMPY_MOST = 900_000_000


def _hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """One draw for populations of any size: by numpy, or by inversion over 14 deviations around the mode."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(max(1.0, drawn * (good / total) * (bad / total) * ((total - drawn) / total)))
    a, b = max(low, mode - int(14 * sd) - 2), min(high, mode + int(14 * sd) + 2)
    k = np.arange(a, b, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1))])
    p = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def _draw(room: np.ndarray, drawn: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``drawn`` rows each target gets, targets having ``room`` slots in all."""
    if room.sum() < NUMPY_MOST:
        return rng.multivariate_hypergeometric(room, drawn, method="marginals")
    if len(room) == 1:
        return np.array([drawn], dtype=np.int64)
    half = len(room) // 2  # halves of the targets, until numpy can draw
    left = _hypergeometric(int(room[:half].sum()), int(room[half:].sum()), drawn, rng)
    return np.concatenate([_draw(room[:half], left, rng), _draw(room[half:], drawn - left, rng)])


def matrix_row(counts: np.ndarray, room: np.ndarray, source: int, seed: int) -> np.ndarray:
    """Row ``source`` of the communication matrix of ``counts`` rows a source and ``room`` slots a target."""
    low, high, node = 0, len(counts), 1
    room = np.asarray(room, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = _draw(room, int(counts[low:middle].sum()), np.random.Generator(np.random.Philox(key=[seed, node])))
        room, low, high, node = (left, low, middle, 2 * node) if source < middle else (room - left, middle, high, 2 * node + 1)
    return room


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def blocks_of(sizes: list[int], block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and number of slots of every block."""
    shard, first, room = [], [], []
    for j, size in enumerate(sizes):
        n = max(1, -(-size // block_rows))
        cuts = [size * i // n for i in range(n + 1)]
        shard += [j] * n
        first += cuts[:-1]
        room += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.array(shard), np.array(first), np.array(room, dtype=np.int64)


def _bytes_of(df: DataFrame, names: list[str]) -> Column:
    """About how many bytes a row has."""
    size = F.lit(16)
    for c in names:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
        else:
            size = size + 8
    return size.cast("long")


def shard_rows(df: DataFrame, shards: int, seed: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard); sizes differ by one row at most.

    A row's place is uniform among all, given the source partition's content and the seed. What is numbered is first
    written to the shared folder, so the result doesn't change when executors are lost. Columns of the input named
    ``shard`` or ``slot`` are replaced.

    Defined cases: nulls in any column are carried along; repeated rows each get a slot of their own; with fewer rows
    than shards some shards are empty; an empty table gives an empty result; the longer the rows, the fewer to a block
    (BLOCK_BYTES, unless that makes more than MOST_BLOCKS), and a row is never split.
    """
    small_batches(df.sparkSession)
    own = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = materialize(
        df.select(
            F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"),
            F.spark_partition_id().alias("__src"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__pos"),
            _bytes_of(df, own).alias("__bytes"),
        ),
        "sharding",
    )
    # Two numbers for each source partition.
    found = {r["__src"]: r for r in numbered.groupBy("__src").agg(F.count("*").alias("n"), F.sum("__bytes").alias("bytes")).collect()}
    sources = sorted(found)
    counts = np.array([found[s]["n"] for s in sources], dtype=np.int64)
    if found:
        block_rows = max(1, min(block_rows, int(BLOCK_BYTES * counts.sum() // sum(r["bytes"] for r in found.values()))))
    block_rows = max(block_rows, -(-int(counts.sum()) // MOST_BLOCKS))
    index = {s: i for i, s in enumerate(sources)}
    shard, first, room = blocks_of(shard_sizes(int(counts.sum()), shards), block_rows)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan: dict[int, np.ndarray] = {}
        for b in batches:
            block = np.empty(len(b), dtype=np.int32)
            src, pos = b["__src"].to_numpy(), b["__pos"].to_numpy()
            for s in np.unique(src):
                if s not in plan:
                    i = index[s]
                    order = np.random.Generator(np.random.Philox(key=[seed, (1 << 40) + i])).permutation(counts[i])
                    to = np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(counts, room, i, seed))
                    plan = {s: to[order]}  # a partition of the written table holds its sources one after the other
                at = src == s
                block[at] = plan[s][pos[at]]
            yield pd.DataFrame({"__src": src, "__pos": pos, "__block": block, "__shard": shard[block].astype(np.int32), "__first": first[block]})

    places = columns(__src="int", __pos="long", __block="int", __shard="int", __first="long")
    dealt = _with_row(numbered.drop("__bytes"), deal, places).repartitionById(len(room), F.col("__block"))  # a task for each block
    w = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed), "__src", "__pos"), "__src", "__pos")
    placed = dealt.withColumn("__slot", F.col("__first") + F.row_number().over(w) - 1)
    return placed.select(*(F.col("__row").getField(c).alias(c) for c in own), F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"))


def _with_row(numbered: DataFrame, deal, places: T.StructType) -> DataFrame:
    """``deal`` beside the row's own columns, batch by batch."""
    schema = T.StructType([numbered.schema["__row"], *places])

    def along(batches):
        import pyarrow as pa

        for b in batches:
            keys = pd.DataFrame({"__src": b.column("__src").to_numpy(zero_copy_only=False), "__pos": b.column("__pos").to_numpy(zero_copy_only=False)})
            for x in deal(iter([keys])):
                yield pa.RecordBatch.from_arrays(
                    [b.column("__row"), *(pa.array(x[f.name].to_numpy(), pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in places)],
                    names=schema.fieldNames(),
                )

    return numbered.mapInArrow(along, schema)

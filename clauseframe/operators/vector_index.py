"""Searched vector index: an inverted file of vectors by their nearest centroid, probed list by list, scored exactly.

Centroids are fitted by spherical k-means on a bounded sample; every vector is assigned to the list of the centroid that
points most its way, and written list by list in packed blocks. A query probes the lists whose centroids it likes best,
and meets the blocks of these only. Scores are exact dot products, so what a search can miss is a vector whose list it
didn't probe; ``recall`` measures that against ``retrieve.top_k``, the exact path.

Lists are split into shards by their size, so a list that holds a third of all vectors is searched by many tasks. What
every task gets is the centroids, whose number is bounded; queries and vectors stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.operators.retrieve import BLOCK_BYTES, packed, scored_blocks

#: Vectors that centroids are fitted on, at most: the first by a hash of the identifier. Lists at most, and rounds of fitting.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 50_000, 4096, 15
#: Bytes of vectors of a shard, about: what one task of a search goes through for a block of queries.
SHARD_BYTES = 256 << 20
#: Share of the neighbours of so many sampled vectors whose lists a search is to probe, unless it is told how many lists.
TARGET, TRIED, NEIGHBOURS = 0.97, 256, 10
#: The list of vectors of another length than the centroids; each query that is as long searches it.
OTHERS = -1


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows, the first by a hash of a column; a bound on the hash leaves about twice as many to be sorted."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(h < -(1 << 63) + (2 * most << 64) // n)
    return rows.orderBy(h, key).limit(most)


def fit_centroids(vectors: np.ndarray, lists: int, seed: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means, started from distinct vectors; a list that gets none starts again from the worst served vector."""
    rng = np.random.default_rng(seed)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    start = np.unique(unit, axis=0)
    found = start[rng.permutation(len(start))[:lists]]
    for _ in range(rounds):
        near, best = _nearest(unit, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, unit)
        empty = np.flatnonzero(np.bincount(near, minlength=len(found)) == 0)
        sums[empty] = unit[np.argsort(best, kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def needed_probes(vectors: np.ndarray, centroids: np.ndarray, seed: int = 1) -> int:
    """How many lists sampled vectors have to probe to find their neighbours among the sample. These are further away than
    their neighbours among all vectors, so this is rather too many than too few."""
    tried = vectors[np.random.default_rng(seed).permutation(len(vectors))[:TRIED]]
    k = min(NEIGHBOURS + 1, len(vectors))  # a vector itself too
    near = np.argpartition(-(tried @ vectors.T), k - 1, axis=1)[:, :k]
    lists = _nearest(vectors, centroids)[0][near]
    place = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(np.take_along_axis(place, lists, axis=1), TARGET, method="higher"))


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, best = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors))
    for i in range(0, len(vectors), 8192):
        scores = vectors[i : i + 8192] @ centroids.T
        near[i : i + 8192] = scores.argmax(axis=1)
        best[i : i + 8192] = scores.max(axis=1)
    return near, best


@dataclass(frozen=True)
class VectorIndex:
    """Centroids by list; how many lists a search probes; shards of each list; the packed vectors (list, shard, e_width, e_ids, e_matrix, e_ further columns)."""

    centroids: np.ndarray
    probes: int
    lists: DataFrame
    blocks: DataFrame

    @classmethod
    def build(cls, examples: DataFrame, path: str, example_id: str = "example_id", vector: str = "embedding", carry: list[str] | None = None, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> VectorIndex:
        """Index every row that has a vector under ``path``, which executors share; about as many lists as the root of the rows.

        Null and empty vectors aren't indexed, as they match nothing; vectors of another length than most of the sample's are kept
        in a list of their own; rows that repeat an identifier are all kept; a table without vectors makes an index without lists.
        """
        spark = examples.sparkSession
        rows = examples.select(F.col(example_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), *(F.col(c) for c in carry or [])).where(F.size("v") > 0)
        n = rows.count()
        lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.asarray(v) for b in batches for v in b.column(0).to_pylist()]
            if held:
                widths = [len(v) for v in held]
                width = max(set(widths), key=lambda w: (widths.count(w), w))
                vectors = np.stack([v for v in held if len(v) == width])
                made = fit_centroids(vectors, lists, seed)
                probes = needed_probes(vectors, made, seed)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array(list(made), pa.list_(pa.float64())), pa.array([probes] * len(made), pa.int32())], names=["list", "centroid", "probes"])

        # One task fits, on a bounded number of vectors; what comes back are the centroids.
        bounded_sample(rows.select("id", "v"), "id", sample_rows, seed).select("v").coalesce(1).mapInArrow(fit, "list int, centroid array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centroids")
        centroids, _ = _read_centroids(spark, path)
        assigned = _assigned(rows, centroids)
        sizes = assigned.groupBy("list").agg(F.ceil(F.sum(F.size("v") * 8) / SHARD_BYTES).cast("int").alias("shards"))
        sizes.write.mode("overwrite").parquet(f"{path}/lists")
        known = spark.read.parquet(f"{path}/lists")
        placed = assigned.join(F.broadcast(known), "list")  # a row for each list
        placed = placed.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")
        dealt = placed.repartitionByRange("list", "shard", F.xxhash64("id")).sortWithinPartitions("list", "shard")
        packed(dealt, "e", ["list", "shard"]).write.mode("overwrite").parquet(f"{path}/blocks")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(*_read_centroids(spark, path), spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/blocks"))

    def search(
        self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", probes: int | None = None, threshold: float | None = None,
        by: list[str] | None = None, exclude_self: bool = False,
    ) -> DataFrame:
        """(query_id, example_id, score, rank, *by) as ``retrieve.top_k`` gives them, from the lists that each query probes."""
        by = by or []
        probes = probes or self.probes
        centroids = self.centroids

        kind = queries.schema[query_id].dataType
        out = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType()))])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, vectors = b.column(0), b.column(1).to_pylist()
                at, lists = [], []
                for i, v in enumerate(vectors):
                    near = [OTHERS]
                    if len(centroids) and len(v) == centroids.shape[1]:
                        near += np.argsort(-(centroids @ np.asarray(v)), kind="stable")[:probes].tolist()
                    at += [i] * len(near)
                    lists += near
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), ids.take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64()))], names=out.fieldNames())

        asked = queries.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0).mapInArrow(probe, out)
        asked = asked.join(F.broadcast(self.lists), "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        dealt = asked.repartition("list", "shard").sortWithinPartitions("list", "shard")
        met = packed(dealt, "q", ["list", "shard"]).join(self.blocks, ["list", "shard"]).where("q_width = e_width")
        scored = scored_blocks(met, k, kind, self.blocks, by, threshold, exclude_self)
        w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.asc("example_id"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _read_centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """At most MOST_LISTS, or as many as were asked for; and the probes that go with them."""
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    return (np.array(found["centroid"].to_pylist()), found["probes"][0].as_py()) if found.num_rows else (np.zeros((0, 0)), 0)


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    out = T.StructType([T.StructField("list", T.IntegerType()), *rows.schema])
    step = max(1, BLOCK_BYTES // (8 * max(1, centroids.shape[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                vectors = [np.asarray(v) for v in b.column(1).to_pylist()]
                lists = np.full(len(vectors), OTHERS, dtype=np.int32)
                fit = [j for j, v in enumerate(vectors) if len(centroids) and len(v) == centroids.shape[1]]
                if fit:
                    lists[fit] = _nearest(np.stack([vectors[j] for j in fit]), centroids)[0]
                yield pa.RecordBatch.from_arrays([pa.array(lists), *b.columns], names=out.fieldNames())

    return rows.mapInArrow(run, out)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many pairs the exact search has, and which share of them was found."""
    hit = found.select("query_id", "example_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "example_id"], "left").agg(F.count("*").alias("n_exact"), (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))

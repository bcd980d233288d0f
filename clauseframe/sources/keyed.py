"""A table with one row for each key, in buckets of keys, of which an upsert reads and writes only those that it touches."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Upserted:
    """What one batch did: whether it was new, the buckets it touched, and how many of them had rows to read."""

    applied: bool
    buckets: tuple[int, ...] = ()
    read: int = 0


class KeyedTable:
    """Rows by key, each the largest by ``order`` (then by its other columns) of all that were ever upserted, or the smallest.

    A key lies in the bucket that its hash names. A batch's buckets are read, merged and written to a folder of their own;
    a manifest, one small file for each commit, says where each bucket lies and which batch of each writer came last, and
    is put in place by a rename. So readers see whole commits; a batch that is run again, after a crash on either side of
    its commit, changes nothing twice; and what a batch costs grows with the buckets it touches. There is one writer at a
    time, as a stream has one driver. Null keys are a key. Columns must have an order (no maps). ``splits`` tasks share a
    bucket; the number of buckets is the table's for good.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64, splits: int = 1, largest: bool = True):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order
        self.buckets, self.splits, self.largest = buckets, splits, largest
        state = self.manifest()
        if state["seq"] and state["buckets_of_table"] != buckets:
            raise ValueError(f"the table has {state['buckets_of_table']} buckets, not {buckets}")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """The last commit: seq, buckets (bucket to folder), applied (writer to batch)."""
        files, at = self._files(f"{self.path}/commits")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        last = max((n for n in names if n.endswith(".json") and n[0].isdigit()), default=None)
        if last is None:
            return {"seq": 0, "buckets": {}, "applied": {}, "buckets_of_table": self.buckets}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{last}", wholetext=True).first()["value"])

    def _commit(self, state: dict) -> None:
        files, draft = self._files(f"{self.path}/commits/.{uuid.uuid4().hex}")
        _, final = self._files(f"{self.path}/commits/{state['seq']:020d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"commit {state['seq']} of {self.path} was made by another writer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _best(self, rows: DataFrame, *by: str) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys and c not in self.order]
        held = F.struct(*[F.col(f"`{c}`") for c in [*self.order, *rest]])
        best = (F.max if self.largest else F.min)(held).alias("__row")
        found = rows.groupBy(*by, *[F.col(f"`{k}`") for k in self.keys]).agg(best)
        return found.select(*by, *[F.col(f"`{c}`") if c in self.keys else F.col(f"__row.`{c}`").alias(c) for c in self.schema.names])

    def upsert(self, rows: DataFrame, writer: str, batch: int) -> Upserted:
        """Merge a batch in; the second run of a batch, known by its writer and number, is a no-op."""
        state = self.manifest()
        if batch <= state["applied"].get(writer, -1):
            return Upserted(False)
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        self._best(rows.select(*[F.col(f"`{c}`") for c in self.schema.names])).withColumn("__bucket", self._bucket()).write.parquet(stage)
        new = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("__bucket", T.IntegerType())])).parquet(stage)
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # no more than there are buckets
        old = [state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]]
        if old:
            new = new.unionByName(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in old]).withColumn("__bucket", self._bucket()))
        if touched:
            split = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys], F.lit(1)), F.lit(self.splits)).cast("int")
            dealt = new.withColumn("__split", split).repartition(max(1, len(touched) * self.splits), "__bucket", "__split")
            folder = f"data/{uuid.uuid4().hex}"
            self._best(dealt, "__bucket", "__split").drop("__split").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
            state["buckets"] |= {str(b): f"{folder}/__bucket={b}" for b in touched}
        self._commit({"seq": state["seq"] + 1, "buckets": state["buckets"], "applied": state["applied"] | {writer: batch}, "buckets_of_table": self.buckets})
        files, at = self._files(stage)
        files.delete(at, True)
        return Upserted(True, tuple(touched), len(old))

    def read(self) -> DataFrame:
        """The table as of the last commit."""
        folders = sorted(self.manifest()["buckets"].values())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in folders])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys, from the buckets where they lie."""
        state = self.manifest()["buckets"]
        found = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        folders = sorted(state[str(b)] for b in found if str(b) in state)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        keys = wanted.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in folders]).join(keys, same, "left_semi")

    def vacuum(self) -> int:
        """Delete folders of buckets that the last commit doesn't name any more, for when no reader is at an older one; how many."""
        live = set(self.manifest()["buckets"].values())
        files, top = self._files(f"{self.path}/data")
        gone = 0
        for folder in files.listStatus(top) if files.exists(top) else []:
            for bucket in files.listStatus(folder.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("__bucket=") and f"data/{folder.getPath().getName()}/{name}" not in live:
                    gone += files.delete(bucket.getPath(), True)
        return gone

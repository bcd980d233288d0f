"""Exact duplicates by content sort.

Sampled splitters range-partition the bytes of the normalised texts, an external sort inside each range puts
equal texts next to each other, and each text is compared in full with its neighbour. Spark samples the
splitters; their key is (first bytes, hash of all bytes, identifier, number of the row), so a splitter is small
however long the texts are, and a group of copies of any size is cut into as many ranges as its rows need. Runs that
touch the edge of a range are put together by their full text, and their rows joined to what that gives.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseframe.llm.common import handing_back, materialize, small_batches

#: Bytes of a text that take part in a splitter.
PREFIX_BYTES = 32
#: Rows that Spark samples for each range: the ranges' sizes vary by about a quarter, and the driver sees few rows.
SAMPLES = 20
#: Rows of an output batch, and characters of texts carried in it.
OUT_ROWS, OUT_CHARS = 20_000, 16_000_000


class _Run:
    """Rows of one text that follow each other in one range."""

    __slots__ = ("key", "text", "sha", "ids", "number", "payload")

    def __init__(self, key, text, sha, number):
        self.key, self.text, self.sha, self.number = key, text, sha, number
        self.ids: list = []
        self.payload = None


def _scan(schema: T.StructType, carry: bool, inside: int | None):
    """inside: where in the carried row the text is, if it has no column of its own."""
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        chars = 0
        first_key = run = None
        waiting: list[_Run] = []  # the closed runs of the key that is being read; more than one only if hashes collide
        number = 0

        def emit(r: _Run, edge: bool) -> int:
            n, last = len(r.ids), r.ids[-1]
            payload = r.payload.as_py() if carry else None
            for i, one in enumerate(r.ids):
                end = i == n - 1
                out.append((
                    one, r.sha, None if edge else last, None if edge else n, end, part, r.number if edge else None,
                    n if edge and end else None, r.text if edge and end else None, *((payload if end else None,) if carry else ()),
                ))
            return len(r.text) * (edge + carry)

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            columns = {n: b.column(n) for n in b.schema.names}
            ids, shas, prefixes, hashes = (columns[c].to_pylist() for c in ("__id", "__sha", "__prefix", "__hash"))
            texts = columns["__text"].to_pylist() if inside is None else [x or "" for x in columns["__row"].field(inside).to_pylist()]
            payload = columns.get("__row")
            for i, text in enumerate(texts):
                if run is None or text != run.text:
                    key = (prefixes[i], hashes[i])
                    if run is None:
                        first_key = key
                    elif run.key != key:
                        for r in (*waiting, run):
                            chars += emit(r, r.key == first_key)
                        waiting = []
                    else:
                        waiting.append(run)
                    if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                        yield flush()
                        chars = 0
                    run = _Run(key, text, shas[i], number)
                    number += 1
                run.ids.append(ids[i])
                if carry:
                    run.payload = payload[i]
        for r in [*waiting, *([run] if run else [])]:
            emit(r, True)
        yield flush()

    return scan


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalize: Column | None = None, carry: bool = False
) -> DataFrame:
    """Every row with its group of equal texts.

    Returns ``__id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and, with ``carry``, ``__row``: all columns
    of the rows that stay, null for the others. ``normalize`` is the text to compare (default: the text itself).

    Defined cases: a null text counts as empty; all empty texts are one group; a null identifier is kept only if its group has no other;
    of several rows with the kept identifier exactly one is kept; an empty table gives an empty result; other columns
    are neither read nor touched unless carried, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`") if normalize is None else normalize, F.lit(""))
    inside = df.columns.index(text_col) if carry and normalize is None else None  # one copy of a text is enough to move
    rows = df.select(
        F.col(f"`{id_col}`").alias("__id"), *([] if inside is not None else [text.alias("__text")]), F.sha2(text, 256).alias("__sha"),
        F.substring(F.encode(text, "UTF-8"), 1, PREFIX_BYTES).alias("__prefix"), F.xxhash64(text).alias("__hash"), F.monotonically_increasing_id().alias("__n"),
        *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")] if carry else []),
    )
    body = F.col("__text") if inside is None else F.coalesce(F.col("__row").getField(text_col), F.lit(""))
    # The row to keep comes last.
    last = F.col("__id").asc_nulls_first() if keep == "largest" else F.col("__id").desc_nulls_first()
    ranged = rows.repartitionByRange("__prefix", "__hash", last, "__n").sortWithinPartitions("__prefix", "__hash", body, last).drop("__n")
    id_type = rows.schema["__id"].dataType
    schema = T.StructType([
        T.StructField("__id", id_type), T.StructField("__sha", T.StringType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()),
        T.StructField("__last", T.BooleanType()), T.StructField("__part", T.IntegerType()), T.StructField("__run", T.LongType()),
        T.StructField("__run_size", T.LongType()), T.StructField("__edge_text", T.StringType()), *([T.StructField("__row", rows.schema["__row"].dataType)] if carry else []),
    ])
    with _setting(df.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SAMPLES)):
        scanned = materialize(ranged.mapInArrow(handing_back(_scan(schema, carry, inside)), schema), "exact-dedup")
    # Only rows of runs at edges need the join: a few runs a range, and the ranges of copies that fill several.
    edge = scanned.where("__run IS NOT NULL")
    runs = edge.where("__edge_text IS NOT NULL").select("__edge_text", "__part", "__run", "__run_size", "__id")
    texts = runs.groupBy("__edge_text").agg(F.sum("__run_size").alias("__n"), F.max(F.struct("__part", "__run", "__id")).alias("__best"))
    met = runs.select("__edge_text", "__part", "__run").join(texts, "__edge_text").select("__part", "__run", "__n", "__best")
    best = F.col("__best")
    found = edge.join(met, ["__part", "__run"]).withColumns({
        "keep_id": best["__id"], "group_size": F.col("__n"), "__last": F.col("__last") & (F.col("__part") == best["__part"]) & (F.col("__run") == best["__run"]),
    })
    out = ["__id", "keep_id", "group_size", F.col("__last").alias("kept"), F.col("__sha").alias("text_sha256"), *(["__row"] if carry else [])]
    return scanned.where("__run IS NULL").select(*out).unionByName(found.select(*out))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalize: Column | None = None) -> DataFrame:
    """The table with one row of each group of equal texts; columns and rows otherwise as they were."""
    kept = exact_groups(df, id_col, text_col, keep, normalize, carry=True).where("kept")
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in df.columns))

"""What several operators share: words, shared storage, clash-free names."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseframe.sources.sinks import scratch_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker: whole texts may be long, and a worker holds a few batches at once.
BATCH_BYTES = 2 << 20
#: Bytes of a row group of a table between steps: what a writing task holds.
GROUP_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Let this session hand texts to Python workers in batches of bounded bytes; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).removesuffix("b")) if spark.conf.get(key).removesuffix("b").lstrip("-").isdigit() else 0
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is written there goes when nothing reads it any more."""
    path = f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    noted = _noted.get()
    if noted is not None:
        noted.append(path)
    else:
        _left.setdefault(spark.sparkContext.applicationId, []).append(path)
        if len(_left) == 1:
            atexit.unregister(_clear)
            atexit.register(_clear, spark)
    return path


def materialize(df: DataFrame, tag: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder (a new path there, if none is given) and read it again: cuts the lineage and
    survives lost executors.

    Whatever is drawn or numbered before this point is data after it, so a recomputed task can't change it.
    """
    path = path or new_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", GROUP_BYTES).option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Where tables are noted that this context writes, if anywhere; tables of results that are read later, by application.
_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)
_left: dict[str, list[str]] = {}


def _clear(spark: SparkSession) -> None:
    """At the driver's end nothing reads its tables any more."""
    with contextlib.suppress(Exception):
        for p in _left.pop(spark.sparkContext.applicationId, []):
            _delete(spark, p)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note the tables that are written meanwhile, by this thread."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def release(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> None:
    """Delete noted tables, but for those that ``needed`` still reads."""
    held = {f.rsplit("/", 1)[0].removeprefix("file://") for f in needed.inputFiles()} if needed is not None else set()
    for p in [p for p in paths if p.removeprefix("file://") not in held]:
        _delete(spark, p)
        paths.remove(p)


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote; call it only when nothing will read it any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(df.sparkSession, f)


def first_by_hash(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` of the table's distinct rows: the first by a hash of ``key``, then by all columns.

    A bound on the hash, from the number of keys, leaves about twice as many to be sorted, so that no partition passes
    on more than its part of these. Equal rows count once, so a frequent key doesn't take the places of others.
    """
    keys = df.agg(F.approx_count_distinct(key)).first()[0]
    h = F.xxhash64(F.lit(seed), key)
    if keys > 2 * rows:
        df = df.where(h < -(1 << 63) + (2 * rows << 64) // keys)
    return df.dropDuplicates().orderBy(h, *df.columns).limit(rows)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def columns(**kinds: str) -> T.StructType:
    """A schema from simple type names, ``x[]`` for arrays; unlike DDL it needs no session."""
    return T.StructType([T.StructField(n, T.ArrayType(_TYPES[k[:-2]]) if k.endswith("[]") else _TYPES[k]) for n, k in kinds.items()])


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting as none, without building them."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the worker gives the memory it doesn't need to the system: workers are kept for later tasks
    of any kind, and an executor's limit counts what they all hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                    ctypes.CDLL(None).malloc_trim(0)

    return run


def map_texts(df: DataFrame, id_col: str, text_col: str, work: Callable[[list[str]], pd.DataFrame], schema: T.StructType, chunk_chars: int = 2_000_000, carry: bool = False) -> DataFrame:
    """``work`` on the whole texts (null as empty) of every row, some at a time; the identifier goes along untouched.

    With ``carry`` the first column is ``__row`` instead, a struct of all columns of the row.
    """
    small_batches(df.sparkSession)
    if carry:
        first, kind = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), df.schema
    else:
        first, kind = F.col(f"`{id_col}`").alias("__id"), df.schema[id_col].dataType
    out = T.StructType([T.StructField("__row" if carry else id_col, kind), *schema])
    arrow, at = to_arrow_schema(schema), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if x is None else x for x in (b.column(0).field(at) if carry else b.column(1)).to_pylist()]
            start = chars = 0
            for i, x in enumerate(texts):
                chars += len(x)
                if chars >= chunk_chars or i == len(texts) - 1:
                    made = pa.RecordBatch.from_pandas(work(texts[start : i + 1]), schema=arrow, preserve_index=False)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, i + 1 - start), *made.columns], names=out.fieldNames())
                    start, chars = i + 1, 0

    return df.select(first, *([] if carry else [F.col(f"`{text_col}`").alias("__text")])).mapInArrow(handing_back(run), out)

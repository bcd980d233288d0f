"""Sinks: whole tables, replaced or upserted by key, so that a second run leaves no second copy."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.schemas import INDEX_INFO


_own: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """Where tables between stages go: the folder that the cluster names for checkpoints, or, where it names none, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="clauseframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_stage(df: DataFrame, path: str, keys: list[str]) -> int:
    """Add the rows whose keys the table doesn't hold yet; how many there were."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, parts: list[str] | None = None) -> None:
    """A batch's input: one string column; with ``parts``, columns besides it by which lines go to folders of their own."""
    lines.write.mode("overwrite").partitionBy(*(parts or [])).text(path)


def write_by_verdict(docs: DataFrame, path: str) -> None:
    """Accepted, unknown and rejected documents in folders of their own."""
    docs.write.mode("overwrite").partitionBy("verdict").parquet(path)


def write_by_language(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("lang_bucket").parquet(path)


def quarantine(errors: DataFrame, path: str) -> None:
    errors.select("pkg", "stage", "message").write.mode("append").parquet(path)


def log_calls(calls: DataFrame, path: str) -> int:
    """Answers into the ledger, once for each id."""
    return append_stage(calls, path, ["custom_id"])


def write_index(examples: DataFrame, path: str, model_name: str) -> None:
    """The example table, and one row that says what it holds."""
    examples.write.mode("overwrite").parquet(f"{path}/examples")
    count = lambda kind: F.count(F.when(F.col("example_type") == kind, 1)).cast("int")
    both = F.struct(count("annotate").alias("annotate"), count("classify").alias("classify"))
    stats = examples.agg(F.lit(model_name).alias("model_name"), F.max(F.size("embedding")).alias("embedding_dimension"), both.alias("total_examples"), both.alias("total_embeddings"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    stats.select(*INDEX_INFO.fieldNames()).coalesce(1).write.mode("overwrite").json(f"{path}/info")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/examples")

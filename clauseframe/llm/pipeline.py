"""A training corpus from raw documents: toxic ones out, exact and near duplicates out, sources mixed, texts as piece ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a table; all but the last
return the columns of ``documents``. A stage's result is to be written before the next stage begins, as ``run`` does:
what a stage wrote on its way is deleted when its thread begins the next one.

Defined cases, for every stage: an empty table gives an empty result; null texts count as empty, so they are one group
of exact copies, have no shingles, and are never mixed in; null identifiers, null sources and repeated rows are kept as
the stage's own rule says (of repeated rows with one text, exact dedup leaves one); further columns go along untouched,
whatever their names.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from clauseframe.llm.common import recorded, release
from clauseframe.session import table
from clauseframe.sources.sinks import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The chain's order: junk first, as it changes what words look like, then toxic.
CATEGORIES = ["low_quality", "toxic"]
#: Tables that the last stage of this thread wrote on its way.
_left: contextvars.ContextVar[list[str]] = contextvars.ContextVar("left")


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.get(None)
        if left is None:
            _left.set(left := [])
        release(spark, left, docs)
        with recorded(left):
            return work(spark, docs, sf_dir)

    return run_stage


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(table(spark, sf_dir, "documents"), labels, CATEGORIES)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic, as they were."""
    return toxicity.keep_clean(docs, toxicity_chain(spark, sf_dir))


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect, the one with the smallest identifier."""
    return near_dedup.drop_near_duplicates(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, as often as a mix by source weights takes them."""
    mixed = mixing.mixed_documents(mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text read back from them."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies),
    ("source mixing", mix_sources), ("piece encoding", encode_pieces),
]

#: The models of the first stage and the draws of the fourth have no counterpart in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last one's table stays."""
    docs = table(spark, sf_dir, "documents")
    top = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    context = contextvars.copy_context()  # a run's own, whatever else this thread has begun

    def stages() -> DataFrame:
        nonlocal docs
        written: list[str] = []
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
            release(spark, written)
            docs = spark.read.parquet(f"{top}/{k}")
            written.append(f"{top}/{k}")
        release(spark, _left.get(), docs)
        return docs

    context.run(_left.set, [])
    return context.run(stages)

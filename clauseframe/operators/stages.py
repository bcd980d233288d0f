"""The model stages as functions from table to table. Passages carry pkg, idx, type, context, passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseframe.functions import llmjson, vocab
from clauseframe.functions import text as X
from clauseframe.operators import ledger, prompts
from clauseframe.operators.backends import Backend
from clauseframe.schemas import ANNOTATIONS

#: Output tokens of each task.
MAX_TOKENS = {"detect": 1, "classify": 1024, "annotate": 8192, "targeted_annotate": 8192, "review": 8192}
_ANNOTATION_DDL = "struct<requirement:string,value:string,performed:boolean>"


def passage_message(scheme: str = vocab.TRANSPARENCY) -> Column:
    return F.to_json(F.struct("type", "context", "passage") if scheme == vocab.TRANSPARENCY else F.struct("passage"))


def _ask(rows: DataFrame, backend: Backend, run: str, task: str, model: str, messages: Column, idx: Column | None = None) -> DataFrame:
    """The rows with the answer to each (response, in_tokens, out_tokens, secs, error), each prompt asked once however many rows share it.

    Rows whose messages are null aren't asked about. Prompts and rows meet again by the prompt's hash, in one join.
    """
    messages = messages.cast(prompts.MESSAGES)
    wanted = ledger.requests(rows.withColumn("idx", F.col("idx") if idx is None else idx), run, task, model, messages).where("messages IS NOT NULL")
    once = wanted.groupBy("prompt_hash").agg(F.min_by(F.struct("custom_id", "messages", "model"), "custom_id").alias("r"))
    answered = backend.answer(once.select("prompt_hash", "r.custom_id", "r.messages", "r.model"))
    answered = answered.select(F.col("prompt_hash").alias("__hash"), "response", "in_tokens", "out_tokens", "secs", "error")
    return rows.withColumn("__hash", ledger.prompt_hash(model, messages)).join(answered, "__hash", "left").drop("__hash")


def detect(docs: DataFrame, backend: Backend, system: str | None = None, run: str = "run", model: str = "rules") -> DataFrame:
    """docs (pkg, text) with ``verdict``: accepted, unknown or rejected, judged on the excerpt around the middle."""
    messages = prompts.messages(F.lit(system).cast("string"), F.lit(None).cast("array<struct<rank:int,user:string,assistant:string>>"), X.excerpt(F.col("text")))
    answers = _ask(docs, backend, run, "detect", model, messages, F.lit(0))
    return answers.select(*(c for c in docs.columns if c != "verdict"), verdict(F.col("response")).alias("verdict"))


def verdict(response: Column) -> Column:
    return F.when(response == "true", "accepted").when(response == "unknown", "unknown").otherwise("rejected")


def classify(passages: DataFrame, backend: Backend, system: str | None = None, fewshots: DataFrame | None = None, scheme: str = vocab.TRANSPARENCY, run: str = "run", model: str = "rules") -> DataFrame:
    """Passages with ``predicted_labels``: what the answer lists, put right against the vocabulary, without Other."""
    rows = _with_fewshots(passages, fewshots)
    met = _ask(rows, backend, run, "classify", model, prompts.messages(F.lit(system).cast("string"), F.col("fewshots"), passage_message(scheme))).select(*passages.columns, "response")
    listed = F.filter(llmjson.label_list(F.col("response")), lambda x: x != vocab.OTHER)
    made = met.withColumn("predicted_labels", F.coalesce(listed, F.array().cast("array<string>"))).drop("response")
    return vocab.correct_labels(made, "predicted_labels", scheme)


def _with_fewshots(passages: DataFrame, fewshots: DataFrame | None) -> DataFrame:
    kind = "array<struct<rank:int,user:string,assistant:string>>"
    if fewshots is None:
        return passages.withColumn("fewshots", F.lit(None).cast(kind))
    return passages.withColumn("query_id", F.concat_ws("_", "pkg", F.col("idx").cast("string"))).join(fewshots, "query_id", "left").drop("query_id")


def _annotated(passages: DataFrame, rows: DataFrame, backend: Backend, task: str, system: Column, scheme: str, run: str, model: str, user: Column, asked: Column | None = None) -> DataFrame:
    """rows: the passages with what their prompts need; those for which ``asked`` isn't true get no annotations."""
    messages = prompts.messages(system, F.col("fewshots"), user)
    answers = _ask(rows, backend, run, task, model, messages if asked is None else F.when(asked, messages))
    met = answers.select(*(c for c in passages.columns if c != "annotations"), "response")
    found = vocab.drop_other(llmjson.response_list(F.col("response"), "annotations", _ANNOTATION_DDL))
    made = met.withColumn("annotations", F.when(F.col("response").isNotNull(), found).otherwise(F.array().cast(ANNOTATIONS))).drop("response")
    return vocab.correct_annotations(made, "annotations", scheme)


def annotate(passages: DataFrame, backend: Backend, system: str | None = None, pairs: list | None = None, scheme: str = vocab.TRANSPARENCY, run: str = "run", model: str = "rules") -> DataFrame:
    """Passages with ``annotations``, by a prompt with fixed few-shots."""
    rows = passages.withColumn("fewshots", prompts.static_fewshots(pairs or []))
    return _annotated(passages, rows, backend, "annotate", F.lit(system).cast("string"), scheme, run, model, passage_message(scheme))


def target_labels(df: DataFrame) -> Column:
    """Given labels if the table has them, else predicted ones, else none."""
    found = [F.col(c) for c in ("labels", "predicted_labels") if c in df.columns]
    return F.coalesce(*found, F.array().cast("array<string>"))


def _filled(system: str | None, labels: Column, background: Column | None) -> Column:
    lines = vocab.requirement_lines(labels, vocab.article_map())
    return X.fill_template(F.lit(system).cast("string"), lines, background if background is not None else F.lit(""))


def targeted_annotate(
    passages: DataFrame, backend: Backend, system: str | None = None, fewshots: DataFrame | None = None, scheme: str = vocab.TRANSPARENCY,
    background: Column | None = None, run: str = "run", model: str = "rules",
) -> DataFrame:
    """Passages with ``annotations`` for their labels only. Passages without labels aren't asked about and get none."""
    rows = _with_fewshots(passages.withColumn("__labels", target_labels(passages)), fewshots)
    return _annotated(passages, rows, backend, "targeted_annotate", _filled(system, F.col("__labels"), background), scheme, run, model, passage_message(scheme), F.size("__labels") > 0)


def review(
    passages: DataFrame, backend: Backend, system: str | None = None, fewshots: DataFrame | None = None, scheme: str = vocab.TRANSPARENCY,
    background: Column | None = None, run: str = "run", model: str = "rules",
) -> DataFrame:
    """Passages with ``annotations`` replaced by what a second look gives."""
    rows = _with_fewshots(passages.withColumn("__labels", vocab.distinct_requirements(F.col("annotations"))), fewshots)
    user = F.to_json(F.struct("type", "context", "passage", "annotations") if scheme == vocab.TRANSPARENCY else F.struct("passage", "annotations"))
    return _annotated(passages, rows, backend, "review", _filled(system, F.col("__labels"), background), scheme, run, model, user)


def span_quality(annotated: DataFrame) -> DataFrame:
    """pkg, idx, n_annotations, n_anchored: how many values occur in their passage."""
    each = annotated.select("pkg", "idx", "passage", F.explode_outer("annotations").alias("a"))
    hit = F.when(F.col("a.value").isNotNull() & X.spans_anchor(F.col("a.value"), F.col("passage")), 1)
    return each.groupBy("pkg", "idx").agg(F.count("a").alias("n_annotations"), F.count(hit).alias("n_anchored"))

"""A run's configuration and the stages it names, from fetched pages to reviewed annotations."""

from __future__ import annotations

import argparse
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.functions import vocab
from clauseframe.operators import backends, html, retrieve, stages
from clauseframe.sources import readers, sinks

#: Model keys in the environment, never shipped to executors.
KEY_VARIABLES = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "deepseek": "DEEPSEEK_API_KEY"}
STAGES = ("clean", "detect", "parse", "classify", "targeted_annotate", "annotate", "review")
MODEL_STAGES = ("detect", "classify", "targeted_annotate", "annotate", "review")
#: Names that configuration files use.
RENAMED = {
    "run_id": "run", "default_model": "model", "root_dir": "out", "use_two_step_annotation": "two_step", "confidence_threshold": "confidence",
    "max_examples_per_requirement": "per_label", "min_example_confidence": "least_confidence", "annotated_folder": "annotated", "crawl_retries": "retries",
}


@dataclass(frozen=True)
class Config:
    """Which stages run, with which model, and where their tables go."""

    run: str = "run"
    out: str | None = None
    scheme: str = vocab.TRANSPARENCY
    model: str = "rules"
    models: dict[str, str] = field(default_factory=dict)
    skip: frozenset[str] = frozenset()
    two_step: bool = True
    use_rag: bool = True
    similar: int = retrieve.SIMILAR
    per_label: int = retrieve.PER_LABEL
    confidence: float = 0.8
    #: Least confidence of a curated example.
    least_confidence: float = 0.8
    #: Stages whose model is asked by batches.
    batch: frozenset[str] = frozenset()
    parallel: int = 8
    #: The only package to work on; how often a fetch is tried; a model server; where annotated policies lie.
    pkg: str | None = None
    retries: int = 2
    hostname: str | None = None
    annotated: str | None = None

    @classmethod
    def from_json(cls, text: str) -> Config:
        """From a JSON object; keys that a run doesn't know are passed over. ``skip_<stage>`` skips a stage, ``batch_<stage>``
        asks its model by batches."""
        return cls._of(json.loads(text))

    @classmethod
    def _of(cls, got: dict) -> Config:
        known = {f.name for f in fields(cls)}
        named = {RENAMED.get(k, k): v for k, v in got.items() if v is not None}
        picked = lambda what: {k[len(what) + 1 :] for k, v in got.items() if k.startswith(f"{what}_") and v is True}
        batch = named.get("batch", ())
        made = {
            "skip": frozenset(picked("skip") | set(named.get("skip", ()))), "batch": frozenset(picked("batch") | (set(MODEL_STAGES) if batch is True else set(batch or ()))),
            "scheme": vocab.PRACTICES if got.get("use_opp_115") else named.get("scheme", vocab.TRANSPARENCY),
            "parallel": named["parallel"] if "parallel" in named else 8 if got.get("parallel_prompt", True) else 1,
        }
        return cls(**{k: v for k, v in named.items() if k in known} | made)

    @classmethod
    def from_args(cls, argv: list[str], text: str = "{}") -> Config:
        """From arguments (``--run-id x``, ``--skip-review``, ``--models '{...}'``), which win over a JSON object."""
        flags = [f"{w}_{s}" for w, stages_ in (("skip", STAGES), ("batch", MODEL_STAGES)) for s in stages_] + ["use_rag", "use_opp_115", "parallel_prompt", "use_two_step_annotation"]
        values = [k for k in RENAMED if k not in flags] + ["pkg", "models", "scheme", "similar", "hostname"]
        parser = argparse.ArgumentParser()
        for name in flags:
            parser.add_argument("--" + name.replace("_", "-"), action=argparse.BooleanOptionalAction, default=None)
        for name in values:
            parser.add_argument("--" + name.replace("_", "-"))
        given = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
        kinds = {"models": json.loads, "similar": int, "max_examples_per_requirement": int, "crawl_retries": int, "confidence_threshold": float, "min_example_confidence": float}
        return cls._of(json.loads(text) | {k: kinds[k](v) if k in kinds else v for k, v in given.items()})

    def steps(self) -> list[str]:
        """The stages of this run, in order."""
        annotating = ["classify", "targeted_annotate"] if self.two_step else ["annotate"]
        return [s for s in ("clean", "detect", "parse", *annotating, "review") if s not in self.skip]

    def model_of(self, step: str) -> str:
        return self.models.get(step, self.model)

    def secret(self, provider: str) -> str | None:
        return os.environ.get(KEY_VARIABLES.get(provider, ""))


@dataclass
class State:
    """How far a run is; ``notify`` is called when it changes."""

    status: str = "idle"
    step: str | None = None
    done: int = 0
    total: int = 0
    packages: int = 0
    messages: list[str] = field(default_factory=list)
    notify: Callable[[State], None] | None = None

    @property
    def progress(self) -> float:
        return self.done / max(1, self.total)

    def update(self, **changes) -> None:
        before = (self.status, self.step, self.done)
        for k, v in changes.items():
            setattr(self, k, v)
        if self.notify and before != (self.status, self.step, self.done):
            self.notify(self)


def run(
    spark: SparkSession, pages: DataFrame, config: Config, backend_of: Callable[[str], backends.Backend] | None = None, examples: DataFrame | None = None,
    state: State | None = None, prompts: dict[str, str] | None = None, knowledge: DataFrame | None = None, transport: backends.Transport | None = None,
) -> DataFrame:
    """pages (pkg, html) through the run's stages; passages with annotations.

    Pages that are clearly not wanted leave after detection. Pure stages stay one plan; passages, and what every stage that asks a
    model returns, are written and read again, so that no answer is asked for twice: to ``out``, or to a folder of the run's own.
    ``knowledge``: records of the scheme's labels (legal or category records), from which prompts get their background.
    ``transport``: the provider that stages in ``config.batch`` are asked by. Without ``examples``, few-shots come from
    the curated ones.
    """
    offline = backend_of or (lambda task: backends.lexical(task, config.parallel))

    def backend_of(step: str) -> backends.Backend:
        if step not in config.batch:
            return offline(step)
        if transport is None:
            raise ValueError(f"{step} is to be asked by batches, and there is no transport")
        return backends.Batch(f"{out}/batches/{step}", transport, model=config.model_of(step), max_tokens=stages.MAX_TOKENS[step])

    pages = pages if config.pkg is None else pages.where(F.col("pkg") == config.pkg)
    state, prompts = state or State(), prompts or {}
    steps = config.steps()
    state.update(status="running", total=len(steps))
    docs, passages = pages, None
    out = config.out or f"{sinks.scratch_folder(spark)}/{config.run}-{uuid.uuid4().hex}"

    def kept(df: DataFrame, step: str) -> DataFrame:
        sinks.write_stage(df, f"{out}/{step}")
        return spark.read.parquet(f"{out}/{step}")

    try:
        for i, step in enumerate(steps):
            state.update(step=step, done=i)
            if step == "clean":
                docs = html.with_clean_html(docs).withColumn("html", F.col("cleaned_html"))
            elif step == "detect":
                judged = stages.detect(html.with_text(docs), backend_of("detect"), prompts.get("detect"), config.run, config.model_of(step))
                docs = kept(judged, step).where("verdict = 'accepted'")
            elif step == "parse":
                passages = kept(html.passages(docs, ["pkg"], "html"), step)
                if state.notify:
                    state.update(packages=passages.select("pkg").distinct().count())
            else:
                shots = _fewshots(passages, examples, config, step)
                work = {"classify": stages.classify, "targeted_annotate": stages.targeted_annotate, "annotate": stages.annotate, "review": stages.review}[step]
                more = {} if step == "annotate" else {"fewshots": shots}
                asked = passages
                if knowledge is not None and step in ("targeted_annotate", "review"):
                    asked = _with_background(passages, knowledge, config, step)
                    more["background"] = F.col("__background")
                made = work(asked, backend_of(step), prompts.get(step), scheme=config.scheme, run=config.run, model=config.model_of(step), **more)
                passages = kept(made.drop("__background"), step)
        state.update(status="completed", done=len(steps))
    except Exception as e:
        state.messages.append(f"{type(e).__name__}: {e}")
        state.update(status="failed")
        raise
    return passages if passages is not None else docs


def _labels_of(passages: DataFrame, step: str) -> Column:
    return vocab.distinct_requirements(F.col("annotations")) if step == "review" else stages.target_labels(passages)


def _with_background(passages: DataFrame, knowledge: DataFrame, config: Config, step: str) -> DataFrame:
    label = F.col("label")
    if config.scheme == vocab.PRACTICES:
        text = vocab.category_text(label, F.col("description"), F.col("usage"))
    else:
        text = vocab.background_text(label, F.col("gdpr_references"), F.col("commentary"))
    asked = passages.withColumn("__asked", _labels_of(passages, step))
    return retrieve.background(asked, knowledge, text, "__asked", "__background").drop("__asked")


def _fewshots(passages: DataFrame, examples: DataFrame | None, config: Config, step: str) -> DataFrame | None:
    if not config.use_rag or step == "annotate" or (examples is None and step == "classify"):
        return None
    from clauseframe.functions.text import query_text

    q = passages.withColumn("query_id", F.concat_ws("_", "pkg", F.col("idx").cast("string")))
    if examples is None:  # no index: the curated examples of each label
        asked = q.select("query_id", _labels_of(passages, step).alias("labels"))
        return retrieve.curated_fewshots(asked, readers.fallback_examples(passages.sparkSession), config.per_label, config.least_confidence)
    q = retrieve.with_embedding(q, query_text(F.col("context"), F.col("passage")))
    least = retrieve.effective_threshold(config.confidence)
    similar = retrieve.similar_fewshots(q, examples, config.similar, least, config.scheme, "classify" if step == "classify" else "annotate")
    if step == "classify":
        return similar
    by_label = retrieve.label_fewshots(q.withColumn("labels", _labels_of(passages, step)), examples, config.per_label, least, config.scheme)
    return retrieve.combined_fewshots(similar, by_label)

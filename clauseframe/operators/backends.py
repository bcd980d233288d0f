"""Where answers come from: a table of recorded ones, fixed rules, or a function of the user's."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseframe.functions import text as X
from clauseframe.operators import ledger
from clauseframe.operators.ledger import with_answers
from clauseframe.operators.retrieve import small_text_batches

_ANSWERS = T.StructType([
    T.StructField("response", T.StringType()), T.StructField("in_tokens", T.LongType()), T.StructField("out_tokens", T.LongType()), T.StructField("secs", T.DoubleType()),
    T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType()),
])


class Backend(Protocol):
    def answer(self, requests: DataFrame) -> DataFrame:
        """The requests with response, in_tokens, out_tokens, secs, error."""


@dataclass
class Replay:
    """Recorded answers (custom_id, response, in_tokens, out_tokens, error), of any provider: one join."""

    answers: DataFrame

    def answer(self, requests: DataFrame) -> DataFrame:
        met = with_answers(requests, self.answers)
        return met.select(*requests.columns, "response", "in_tokens", "out_tokens", F.lit(0.0).alias("secs"), "error")


class Transport(Protocol):
    """A provider's batch interface; the one place where code reaches it."""

    def submit(self, path: str) -> str:
        """Hand in the request lines under a path; the batch's id."""

    def status(self, batch: str) -> str:
        """The state, in the provider's words."""

    def results(self, batch: str) -> str:
        """Where the result lines are: a path that Spark reads."""


@dataclass
class Batch:
    """Answers by a provider's batches: lines are written and counted, handed in, waited for, and results joined by id.

    The lines go to ``folder``, which executors share. What is more than one batch may hold (``most`` characters) goes in
    several, all handed in before the first is waited for. A batch that ends without being completed is an error.
    """

    folder: str
    transport: Transport
    provider: str = "a"
    model: str | None = None
    max_tokens: int = 8192
    every: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    most: int = ledger.BATCH_CHARS

    def answer(self, requests: DataFrame) -> DataFrame:
        from clauseframe.sources import readers
        from clauseframe.streaming.incremental import wait_for_batch

        spark = requests.sparkSession
        line, states = (ledger.batch_line_a, ledger.STATES_A) if self.provider == "a" else (ledger.batch_line_b, ledger.STATES_B)
        model = F.col("model") if self.model is None else F.lit(self.model)
        paths = self._written(requests.select(line(F.col("custom_id"), model, F.col("messages"), self.max_tokens).alias("value")))
        batches = [self.transport.submit(p) for p in paths]
        for batch in batches:
            state = wait_for_batch(lambda batch=batch: self.transport.status(batch), states, self.every, sleep=self.sleep)
            if state != "completed":
                raise RuntimeError(f"batch {batch} is {state}")
        return Replay(readers.recorded_answers(spark, [self.transport.results(b) for b in batches], self.provider)).answer(requests)

    def _written(self, lines: DataFrame) -> list[str]:
        """Every line in one of the folders that come back, each of which a batch may hold: one, if all fit into it.

        Lines are dealt by a hash of their place, to more folders while one of them is too full; a line that no batch
        holds is an error.
        """
        from clauseframe.sources import sinks

        spark, path, n = lines.sparkSession, f"{self.folder}/{uuid.uuid4().hex}", 1
        while True:
            sinks.write_lines(lines.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")), path, ["part"])
            size = F.length("value")
            held = ledger.check_batch(spark.read.text(path).groupBy("part"), most=self.most, more=[F.max(size).alias("longest")]).collect()
            total = sum(r["n_chars"] for r in held)
            if not total or max(r["longest"] for r in held) > self.most:
                raise ValueError(f"a batch of {sum(r['n_lines'] for r in held)} lines and {total} characters")
            if all(r["ok"] for r in held):
                return [f"{path}/part={r['part']}" for r in sorted(held, key=lambda r: r["part"])]
            n = max(n + 1 + n // 4, math.ceil(total / (0.9 * self.most)))


class RateLimited(Exception):
    """What a client raises when a provider says that it is asked too often."""


#: Failures after which it makes sense to ask again.
TRANSIENT = (TimeoutError, ConnectionError, RateLimited)


class Pace:
    """At most so many calls a second, whichever thread makes them."""

    def __init__(self, rate: float | None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.step, self.sleep, self.clock = 1 / rate if rate else 0.0, sleep, clock
        self.free, self.lock = 0.0, threading.Lock()

    def take(self) -> None:
        """Wait for the next place in the line."""
        if not self.step:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.step
        if at > now:
            self.sleep(at - now)


@dataclass
class Function:
    """A Python function from a message list to a text; the one place where code may reach a network.

    Requests are dealt to ``parallel`` tasks (as many as Spark shuffles to, if none is said); each asks with ``threads``
    threads, ``rate`` calls a second at most, and gives answers in the order of its requests. A failure that may pass is
    tried again after a pause that grows, ``tries`` times in all; any other, and the last, is the row's ``error``. How long it
    waits follows from the request and the try, so a task that runs again does the same. All of the request's columns
    go along, so nothing is joined afterwards. What a task asks again after a failure of its own is asked twice, so write the
    answers to the ledger before anything else reads them, and ask only what ``ledger.pending`` leaves.
    """

    ask: Callable[[list[dict]], str]
    parallel: int | None = None
    threads: int = 8
    tries: int = 3
    rate: float | None = None
    wait: Callable[[int, float, bool], float] = X.backoff_seconds
    sleep: Callable[[float], None] = time.sleep

    def answer(self, requests: DataFrame) -> DataFrame:
        """The requests with response, in_tokens, out_tokens, secs, error, and tries: how often each was asked."""
        ask, tries, wait, sleep, rate, threads = self.ask, self.tries, self.wait, self.sleep, self.rate, self.threads
        kept = [c for c in requests.columns if c not in _ANSWERS.fieldNames()]
        out = T.StructType([*(requests.schema[c] for c in kept), *_ANSWERS])
        arrow = to_arrow_schema(_ANSWERS)

        def one(pace: Pace, name: str, messages: list[dict]) -> tuple:
            start, text, problem = time.time(), None, None
            for n in range(1, tries + 1):
                pace.take()
                try:
                    text, problem = ask(messages), None
                    break
                except Exception as e:  # noqa: BLE001  one request's failure is a row, not the job's
                    problem = f"{type(e).__name__}: {e}"
                    if not isinstance(e, TRANSIENT):
                        break
                    if n < tries:
                        sleep(wait(n - 1, 0.5 + zlib.crc32(f"{name} {n}".encode()) / 2**32, isinstance(e, RateLimited)))
            n_in = sum(len((m["content"] or "").split()) for m in messages)
            return text, n_in, len((text or "").split()), time.time() - start, problem, n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pace = Pace(rate, sleep)
            with ThreadPoolExecutor(threads) as pool:
                for b in batches:
                    said = [[{"role": m["role"], "content": m["content"]} for m in row] for row in b.column("messages").to_pylist()]
                    made = list(pool.map(partial(one, pace), b.column("custom_id").to_pylist(), said))
                    columns = list(zip(*made, strict=True)) or [()] * len(arrow)
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], names=out.fieldNames())

        small_text_batches(requests.sparkSession)
        tasks = self.parallel or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return requests.select(kept).repartition(tasks).mapInArrow(run, out)


#: Phrases that point at each label, from the public definitions of the labels.
PHRASES = {
    "Controller Contact": r"contact us|[\w.+-]+@[\w-]+\.\w+", "DPO Contact": r"data protection officer|\bdpo\b", "Data Categories": r"e-?mail address|personal data|ip address|location data",
    "Processing Purpose": r"in order to|to improve|to provide", "Legal Basis for Processing": r"consent|contract|legal obligation", "Legitimate Interests for Processing": r"legitimate interests?",
    "Source of Data": r"from third parties|obtained from", "Data Retention Period": r"retain|for \d+ (?:days|months|years)|as long as", "Data Recipients": r"service providers?|share .{0,40}with|analytics",
    "Third-country Transfers": r"outside the (?:eea|eu)|united states|standard contractual clauses", "Mandatory Data Disclosure": r"required by law|obliged to provide",
    "Automated Decision-Making": r"profiling|automated decision", "Right to Access": r"right to access|access your", "Right to Rectification": r"rectif\w+|correct your",
    "Right to Erasure": r"erasure|delete your|be forgotten", "Right to Restrict": r"restrict\w*", "Right to Object": r"right to object|object to", "Right to Portability": r"portab\w+|portable format",
    "Right to Withdraw Consent": r"withdraw (?:your )?consent", "Right to Lodge Complaint": r"complaint|supervisory authority",
}
_POLICY = re.compile(r"privacy|personal (?:data|information)|data protection|cookies|third part(?:y|ies)|consent", re.IGNORECASE)
_COMPILED = {k: re.compile(v, re.IGNORECASE) for k, v in PHRASES.items()}


def lexical_answer(messages: list[dict], task: str) -> str:
    """Fixed rules that answer as a model would: text with the task's JSON."""
    said = messages[-1]["content"] or ""
    try:
        got = json.loads(said)
        passage = got.get("passage", "") if isinstance(got, dict) else str(got)
    except ValueError:
        passage = said
    if task == "detect":
        n = len(_POLICY.findall(passage))
        return "true" if n >= 2 else "unknown" if n else "false"
    hits = [(k, m[0]) for k, p in _COMPILED.items() if (m := p.search(passage or ""))]
    if task == "classify":
        return json.dumps({"labels": [k for k, _ in hits]})
    return json.dumps({"annotations": [{"requirement": k, "value": v, "performed": True} for k, v in hits]})


def lexical(task: str, parallel: int | None = None) -> Function:
    return Function(lambda messages: lexical_answer(messages, task), parallel)

"""Streams whose state ends with event time: sessions with timers and late rows apart, and answers joined as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several variables and timers for a key.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION_OUT = "kind string, key string, row_id long, start_us long, end_us long, n long"
_OPEN = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("timer", T.LongType())])


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """Streams started inside keep their state in this store; afterwards the session has the one it had."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def merge_spans(spans: list[list[int]], gap: int) -> list[list[int]]:
    """[first, last, rows] in order of time, joined where one begins less than the gap after another's last row."""
    out: list[list[int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += n
        else:
            out.append([first, last, n])
    return out


class _Sessions(StatefulProcessor):
    """A key's open sessions, as spans, and one timer: the first moment from which no row that isn't late can join one of them."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000 or -(2**61)  # none yet: nothing with a time is late
        spans, timer = self._held()
        for batch in rows:
            late = batch[batch["us"] < mark]
            if len(late):
                yield pd.DataFrame({"kind": "late", "key": key[0], "row_id": late["id"], "start_us": late["us"], "end_us": late["us"], "n": 1})
            spans = merge_spans(spans + [[int(t), int(t), 1] for t in batch.loc[batch["us"] >= mark, "us"]], self.gap)
        self._keep(spans, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        spans, _ = self._held()
        closed = [s for s in spans if s[1] + self.gap <= mark]
        self._keep([s for s in spans if s[1] + self.gap > mark], None)  # the timer that has gone off is Spark's to remove
        if closed:
            found = pd.DataFrame({"kind": "session", "key": key[0], "row_id": None, "start_us": [s[0] for s in closed], "end_us": [s[1] for s in closed], "n": [s[2] for s in closed]})
            yield found.astype({"row_id": "Int64"})

    def _held(self) -> tuple[list[list[int]], int | None]:
        if not self.open.exists():
            return [], None
        spans, timer = self.open.get()
        return [list(s) for s in spans], timer

    def _keep(self, spans: list[list[int]], timer: int | None) -> None:
        due = min((-(-(s[1] + self.gap) // 1000) for s in spans), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.open.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.open.update((spans, due))

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, time: str, row: str, gap_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(kind, key, row_id, start_us, end_us, n) of a stream in append mode: each session once, when the watermark has passed
    its last row by the gap, and each row that came too late (``kind`` late), by its identifier.

    A key's state is a span for each session that is still open; a closed one leaves nothing behind, and a key without
    an open session has no state. Late are rows older than the watermark when their micro-batch begins: they change no
    session, and none is lost, as Spark doesn't see the time as such below its own check for late rows. Rows without
    a time are late (with null times); rows without a key are a key's of their own. Sessions that the watermark hasn't
    passed stay in the state. The stream's session needs the RocksDB state store (``state_store``).
    """
    times = stream.withColumn("__t", F.col(f"`{time}`").cast("timestamp")).withWatermark("__t", late)
    rows = times.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.unix_micros("__t"), F.lit(-(2**62))).alias("us"), F.col(f"`{row}`").cast("long").alias("id"))
    found = rows.groupBy("key").transformWithStateInPandas(_Sessions(gap_s * 1_000_000), SESSION_OUT, "append", "eventtime")
    known = lambda c: F.when(F.col(c) != -(2**62), F.col(c)).alias(c)
    return found.select("kind", "key", "row_id", known("start_us"), known("end_us"), "n")


def answers_in_time(requests: DataFrame, answers: DataFrame, asked_at: str = "asked_at", answered_at: str = "answered_at", within: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Every request of a stream with its answer from another: as soon as it comes, or ``missing`` when the time is up.

    A left outer join of two streams. Both have a watermark and an answer's time lies within so much of its request's, so
    a request is kept no longer than until the watermark has passed its time, and an answer no longer than a request may
    still come that it fits. Of several answers with one id the first to arrive counts. ``requests`` has custom_id and
    asked_at, ``answers`` the columns of the ledger's answers and answered_at.
    """
    asked = requests.withWatermark(asked_at, late)
    first = answers.withWatermark(answered_at, late).dropDuplicatesWithinWatermark(["custom_id"])
    said = first.select(F.col("custom_id").alias("__id"), F.col(answered_at).alias("__at"), "response", "in_tokens", "out_tokens", "error")
    fits = (F.col("custom_id") == F.col("__id")) & (F.col("__at") >= F.col(asked_at)) & (F.col("__at") <= F.col(asked_at) + F.expr(f"interval {within}"))
    met = asked.join(said, fits, "leftOuter")
    return met.select(*requests.columns, "response", "in_tokens", "out_tokens", F.when(F.col("__id").isNull(), F.lit("missing")).otherwise(F.col("error")).alias("error"))

"""The same stages over documents as they arrive: file streams, upserts by key, answers when they come."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from clauseframe.operators import html, ledger
from clauseframe.sources import sinks
from clauseframe.sources.keyed import KeyedTable


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 50) -> DataFrame:
    """pkg, url, html of the page files that a folder gets."""
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.select(F.col("page_id").cast("string").alias("pkg"), "url", "html")


def passages_of(pages: DataFrame) -> DataFrame:
    return html.passages(html.with_clean_html(pages), ["pkg"])


def upsert(stream: DataFrame, path: str, keys: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows of a stream into a table, once for each key, also if a batch is run again."""
    writer = stream.writeStream.foreachBatch(lambda df, _: sinks.append_stage(df, path, keys) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_keyed(stream: DataFrame, held: KeyedTable, writer: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows of a stream into a keyed table; a micro-batch costs the buckets it touches, and a batch run again is known by its number."""
    writing = stream.writeStream.foreachBatch(lambda df, batch: held.upsert(df, writer, batch) and None).option("checkpointLocation", checkpoint)
    return (writing.trigger(availableNow=True) if available_now else writing).start()


def unseen(stream: DataFrame, key: str = "url", time_col: str | None = None, horizon: str = "7 days") -> DataFrame:
    """One row for each key: for good, or among rows no further apart than the horizon, so that state stays bounded."""
    if time_col is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with a watermark: the built-in operators, on a table or a stream."""
    times = events.withColumn("ts", F.col("ts").cast("timestamp"))
    times = times.withWatermark("ts", late) if events.isStreaming else times
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = times.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    times = events.withColumn("ts", F.col("ts").cast("timestamp"))
    times = times.withWatermark("ts", late) if events.isStreaming else times
    counted = times.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def state_changes(stream: DataFrame, key: str, order: str, state: str, row: str) -> DataFrame:
    """(key, row, state) of a stream at which a key's state differs from the one before, the first included.

    The last state of each key is kept between micro-batches; inside one, rows are taken in the order of ``order``, then
    ``row``. What a later batch brings is taken to come later.
    """
    kinds = stream.schema
    out = T.StructType([kinds[key], kinds[row], kinds[state]])
    kept = T.StructType([T.StructField("last", T.StringType())])

    def work(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([order, row])
        last = held.get[0] if held.exists else None
        before = rows[state].shift(1, fill_value=last)
        held.update((rows[state].iat[-1],))
        changed = rows[rows[state].ne(before) & ~(rows[state].isna() & before.isna())]
        yield changed[[key, row, state]]

    return stream.select(key, order, row, state).groupBy(key).applyInPandasWithState(work, out, kept, "append", "NoTimeout")


def wait_for_batch(status: Callable[[], str], states: dict[str, str] = ledger.STATES_A, every: float = 60.0, most: float = 86_400.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Ask for a batch's state until it is one that doesn't change any more; a state that is never left doesn't keep it for ever."""
    waited = 0.0
    while True:
        state = states.get(status(), "in_progress")
        if state in ledger.TERMINAL:
            return state
        if waited >= most:
            return "expired"
        sleep(every)
        waited += every


class Progress(StreamingQueryListener):
    """Passes a stream's progress on, at most once in so many seconds."""

    def __init__(self, notify: Callable[[dict], None], every: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.notify, self.every, self.clock = notify, every, clock
        self._last = float("-inf")
        self._lock = threading.Lock()

    def offer(self, what: dict, force: bool = False) -> bool:
        with self._lock:
            now = self.clock()
            if not force and now - self._last < self.every:
                return False
            self._last = now
        self.notify(what)
        return True

    def onQueryStarted(self, event) -> None:
        self.offer({"status": "running", "id": str(event.id)}, force=True)

    def onQueryProgress(self, event) -> None:
        self.offer({"status": "running", "rows": event.progress.numInputRows, "batch": event.progress.batchId})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.offer({"status": "failed" if event.exception else "completed"}, force=True)


def stop(query: StreamingQuery) -> None:
    query.stop()


def stop_run(spark: SparkSession, run: str) -> None:
    """Stop all jobs of a run that was started under its job group."""
    spark.sparkContext.cancelJobGroup(run)

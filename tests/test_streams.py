"""Event-time streams, the keyed table and sketches, on small inputs with awkward rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.operators import sketches
from clauseframe.sources.keyed import KeyedTable
from clauseframe.streaming import event_time, incremental

EVENT = "id long, user string, at timestamp"
ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def run_batches(spark, top, batches, schema, build):
    """Each batch written, then a run of the stream over the folder; the rows of its table."""
    out = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
        out = build(spark.readStream.schema(schema).parquet(f"{top}/in"))
        out.writeStream.option("checkpointLocation", f"{top}/c").format("parquet").option("path", f"{top}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out").collect()


def test_spans_merge_when_less_than_the_gap_apart():
    assert event_time.merge_spans([[10, 12, 2], [0, 1, 1], [6, 6, 1]], 5) == [[0, 1, 1], [6, 12, 3]]
    assert event_time.merge_spans([], 5) == [] and event_time.merge_spans([[3, 3, 1], [3, 3, 1]], 5) == [[3, 3, 2]]


def test_sessions_close_once_and_late_rows_come_out(spark, tmp_path):
    batches = [
        [(1, "a", at(0)), (2, "a", at(20)), (3, None, at(5)), (4, "b", None), (5, "b", at(-(10**9) // 60))],
        [(6, "a", at(15)), (7, "c", at(200)), (7, "c", at(200))],  # 15 is no later than the watermark of the first batch allows
        [],
        [(8, "a", at(16)), (9, "c", at(215)), (10, "d", at(1000))],  # 16 is late by now
    ]
    with event_time.state_store(spark):
        got = run_batches(spark, tmp_path, batches, EVENT, lambda s: event_time.closed_sessions(s, "user", "at", "id"))
    us = lambda m: int(at(m).timestamp() * 1e6)
    closed = {(r.key, r.start_us, r.end_us, r.n) for r in got if r.kind == "session"}
    assert closed == {("a", us(0), us(20), 3), (None, us(5), us(5), 1), ("c", us(200), us(215), 3), ("b", us(-(10**9) // 60), us(-(10**9) // 60), 1)}
    assert sorted((r.row_id, r.start_us) for r in got if r.kind == "late" and r.row_id != 4) == [(8, us(16))]
    assert [(r.key, r.start_us) for r in got if r.row_id == 4] == [("b", None)]
    assert len(got) == 6


def test_answers_in_time_or_missing(spark, tmp_path):
    asked = [[("q1", at(0)), ("q2", at(1)), ("q3", at(2))], [], [("", at(10**5))]]
    said = [[("q1", "yes", at(30))], [("q1", "no", at(31)), ("q3", "old", at(2 + 24 * 60 + 1)), ("q9", "whose?", at(40))], [("", "", at(10**5))]]
    for a, s in zip(asked, said, strict=True):
        spark.createDataFrame(a, "custom_id string, asked_at timestamp").write.mode("append").parquet(f"{tmp_path}/a")
        answers = spark.createDataFrame(s, "custom_id string, response string, answered_at timestamp").selectExpr("*", "1L AS in_tokens", "1L AS out_tokens", "CAST(NULL AS STRING) AS error")
        answers.write.mode("append").parquet(f"{tmp_path}/s")
        streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in "as"]
        found = event_time.answers_in_time(*streams)
        found.writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = {(r.custom_id, r.response, r.error) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").where("custom_id <> ''").collect()}
    assert got == {("q1", "yes", None), ("q2", None, "missing"), ("q3", None, "missing")}


def test_keyed_table_is_the_plain_one(spark, tmp_path):
    rng = random.Random(5)
    held, plain = KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=8, splits=2), {}
    assert held.read().count() == 0 and held.lookup(spark.createDataFrame([("k1",)], "k string")).count() == 0
    for batch in range(4):
        rows = [(None if rng.random() < 0.05 else f"k{rng.randrange(30)}", rng.choice([None, *range(40)]), rng.choice(["x", "y", None])) for _ in range(40)]
        rows += rows[:3]
        done = held.upsert(spark.createDataFrame(rows, ROW), "w", batch)
        assert done.applied and done.read <= len(done.buckets) <= 8
        rank = lambda r: tuple((x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(r[1:]))
        for r in rows:
            if r[0] not in plain or rank(r) > rank(plain[r[0]]):
                plain[r[0]] = r
        assert not held.upsert(spark.createDataFrame(rows, ROW), "w", batch).applied
        assert {tuple(r) for r in held.read().collect()} == set(plain.values()) and held.read().count() == len(plain)
    again = KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=8)
    assert [tuple(r) for r in again.lookup(spark.createDataFrame([(None,), ("nobody",), (None,)], "k string")).collect()] == ([plain[None]] if None in plain else [])
    assert held.vacuum() > 0 and held.vacuum() == 0 and {tuple(r) for r in held.read().collect()} == set(plain.values())
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=9)


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=16)
    held.upsert(spark.createDataFrame([(f"k{i}", 0, "") for i in range(200)], ROW), "w", 0)
    before = held.manifest()["buckets"]
    done = held.upsert(spark.createDataFrame([("k7", 1, "new"), ("k7", 0, "old")], ROW), "w", 1)
    after = held.manifest()["buckets"]
    assert len(before) == 16 and (len(done.buckets), done.read) == (1, 1)
    assert [b for b in before if before[b] != after[b]] == [str(done.buckets[0])]
    assert held.upsert(spark.createDataFrame([], ROW), "w", 2).buckets == () and held.manifest()["applied"] == {"w": 2}
    assert held.upsert(spark.createDataFrame([("k7", 2, "other's")], ROW), "another", 0).applied  # writers count for themselves
    assert held.read().where("k = 'k7'").first().v == "other's" and held.read().count() == 200


def test_a_batch_that_fails_before_its_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=4, largest=False)
    held.upsert(spark.createDataFrame([("a", 1, "first")], ROW), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            held.upsert(spark.createDataFrame([("a", 0, "earlier"), ("b", 5, "")], ROW), "w", 1)
    assert [r.v for r in held.read().collect()] == ["first"]
    assert held.upsert(spark.createDataFrame([("a", 0, "earlier"), ("b", 5, "")], ROW), "w", 1).applied
    assert sorted(r.v for r in held.read().collect()) == ["", "earlier"]  # the smallest by order stays
    stale = held.manifest() | {"seq": 2}
    with pytest.raises(RuntimeError):
        held._commit(json.loads(json.dumps(stale)))


def test_streams_upsert_into_the_keyed_table(spark, tmp_path):
    held = KeyedTable(spark, f"file://{tmp_path}/t", ROW, ["k"], ["at"], buckets=4)
    for i in range(3):
        spark.createDataFrame([("a", i, f"{i}"), (f"b{i}", 0, "")], ROW).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.upsert_keyed(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), held, "s", f"{tmp_path}/c").awaitTermination()
    assert held.read().where("k = 'a'").first().v == "2" and held.read().count() == 4 and held.manifest()["applied"] == {"s": 2}


def test_sketches_of_days_merge_to_those_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), at(60 * rng.randrange(200)), rng.randrange(3000), rng.choice([None, rng.gauss(0, 1)])) for _ in range(8000)] + [("n", None, None, None)]
    df = spark.createDataFrame(rows, "g string, at timestamp, u long, v double")
    days = sketches.day_sketches(df, "s", "at", "g", "u", "v")
    assert days.count() > 15
    got = {r.g: r for r in sketches.report(days, "g", (0.0, 0.5, 1.0)).collect()}
    for g in "ab":
        users, values = {r[2] for r in rows if r[0] == g}, sorted(r[3] for r in rows if r[0] == g and r[3] is not None)
        assert abs(got[g].n_distinct - len(users)) <= 4 * sketches.distinct_error() * len(users) and got[g].n == sum(r[0] == g for r in rows)
        low, mid, high = got[g].quantiles
        assert (low, high) == (values[0], values[-1])
        assert abs(sum(v <= mid for v in values) / len(values) - 0.5) <= 2 * sketches.rank_error()
    assert (got["n"].n, got["n"].n_distinct, got["n"].quantiles) == (1, 0, [None] * 3)
    checked = sketches.against_rows(sketches.report(days, "g"), df, "g", "u", "v").collect()
    assert len(checked) == 3 and all(r.distinct_fits and r.quantiles_fit for r in checked)
    off = sketches.report(days, "g").withColumn("quantiles", F.transform("quantiles", lambda q: q + 1)).withColumn("n_distinct", F.col("n_distinct") * 2)
    assert not any(r.distinct_fits or r.quantiles_fit for r in sketches.against_rows(off.where("g <> 'n'"), df, "g", "u", "v").collect())

"""Registered queries over the small tables, and the pipeline stage by stage against plain versions."""

import collections
import re
import zlib

import pytest

from clauseframe.llm import pipeline, queries, sharding
from clauseframe.llm.common import materialize
from tests.llm.test_operators import AWKWARD, brute_components, plain_targets, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_queries_cover_their_tables(spark, name):
    found = queries.queries()[name](spark, SF)
    rows = {"op4_chat_format": None, "op10_url_filter": "pages"}.get(name, "documents")
    if rows:
        assert found.count() == spark.read.parquet(f"{SF}/{rows}.parquet").count()
    else:
        assert found.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_whole_documents_are_sharded(spark, monkeypatch):
    seen, work = [], sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda df, *a: seen.append(df.columns) or work(df, *a))
    got = queries.op1_sharding(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert seen == [docs.columns]
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    rows = got.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want
    assert got.schema.simpleString() == "struct<doc_id:bigint,size:bigint,text_crc32:bigint,law:string,shard:int,slot:bigint,grown_shard:int>"
    by = [[r.slot for r in rows if r.shard == k] for k in range(8)]
    assert all(sorted(s) == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1 and sum(map(len, by)) == len(want)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_mix_of_all_documents(spark):
    """The contract's columns against a plain version: sizes, targets, what is taken, and a second run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    size = collections.Counter()
    for r in docs:
        size[r.source] += words[r.doc_id]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    got = queries.op9_source_mixing(spark, SF)
    assert got.schema.simpleString() == "struct<doc_id:bigint,size:bigint,source_size:bigint,target:double,taken:bigint>"
    rows, source, taken = {r.doc_id: r for r in got.collect()}, {r.doc_id: r.source for r in docs}, collections.Counter()
    assert set(rows) == set(words) and len(rows) == len(docs)
    for i, r in rows.items():
        assert r.size == words[i] and r.source_size == size[source[i]] and r.target == pytest.approx(want[source[i]]) and 0 <= r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert {i: r.taken for i, r in rows.items()} == {r.doc_id: r.taken for r in queries.op9_source_mixing(spark, SF).collect()}


def test_near_groups_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.OP7_SQL).fetchall()
    assert sorted(map(tuple, queries.op7_near_dedup(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect())) == sorted(want)


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_take_awkward_tables(spark, stage):
    for rows in (AWKWARD, []):
        docs = materialize(table(spark, rows), "awkward")
        got = materialize(stage(spark, docs, SF), "test-stage")
        assert got.columns == docs.columns or stage is pipeline.encode_pieces
        assert got.count() <= 3 * len(rows) and (rows or not got.count())


def test_runs_leave_one_table(spark, tmp_path):
    import glob
    import os

    before = set(glob.glob(f"{pipeline.scratch_folder(spark).removeprefix('file://')}/*"))
    got = pipeline.run(spark, SF)
    assert got.count() > 0
    new = set(glob.glob(f"{pipeline.scratch_folder(spark).removeprefix('file://')}/*")) - before
    assert len(new) == 1 and len(os.listdir(new.pop())) == 1


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), "test-stage"))
    before, clean, exact, near, mixed, encoded = kept
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scores = {r.doc_id: r.kept for r in queries.op5_toxicity(spark, SF).collect()}
    assert ids(clean) == {i for i, k in scores.items() if k}
    best = {}
    for r in clean.collect():
        best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
    assert ids(exact) == set(best.values())

    want, _ = brute_components([(r.doc_id, r.text) for r in exact.select("doc_id", "text").collect()])
    assert ids(near) == {i for i, c in want.items() if i == c}
    size, taken = collections.Counter(), collections.Counter()
    for r in near.collect():
        size[r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert collections.Counter(r.decoded for r in encoded.collect()) == collections.Counter(r.text for r in mixed.collect())

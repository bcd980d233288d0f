"""Searched index, weighted embeddings, language model, vector sums, and prompting by threads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseframe.functions import ngrams
from clauseframe.operators import backends, retrieve, vector_index, weighting


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 3 if i % 2 else i % 12] + rng.normal(size=16) * 0.3], i % 4) for i in range(600)]
    odd = [(700, None, 0), (701, [], 0), (702, [1.0, 2.0], 1), (703, [0.0] * 16, 1), (5, rows[5][1], 1)]
    return spark.createDataFrame(rows + odd, "example_id long, embedding array<double>, label int").repartition(3).persist()


def test_index_holds_and_finds_every_vector(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD_BYTES", 2_000)  # lists of several shards
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "index"), carry=["label"], lists=10)
    assert index.blocks.agg(F.sum(F.size("e_ids"))).first()[0] == vectors.where(F.size("embedding") > 0).count() and index.lists.agg(F.max("shards")).first()[0] > 1
    again = vector_index.VectorIndex.load(spark, str(tmp_path / "index"))
    q = vectors.where("example_id % 20 = 0 OR example_id >= 700").select(F.col("example_id").alias("query_id"), "embedding")
    exact = retrieve.top_k(q, vectors, 4)
    rows = lambda df: sorted((r.query_id, r.example_id, round(r.score, 9), r.rank) for r in df.collect())
    assert rows(again.search(q, 4, probes=10)) == rows(exact)
    assert vector_index.recall(again.search(q, 4), exact).first()["recall"] >= 0.9
    got = again.search(q, 2, probes=10, by=["label"], exclude_self=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, retrieve.top_k(q, vectors, 2, by=["label"], exclude_self=True).select(*got.columns).collect()))


def test_index_of_nothing(spark, vectors, tmp_path):
    index = vector_index.VectorIndex.build(vectors.limit(0), str(tmp_path / "none"))
    assert index.search(vectors.select(F.col("example_id").alias("query_id"), "embedding"), 3).count() == 0


TEXTS = [None, "", "the cat sat", "The CAT sat", "die katze saß", "le chat é", "x" * 5000, "\U0001f600", "the cat sat"]


def test_tfidf_is_the_plain_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "example_id long, text string").repartition(2)
    model = weighting.TfIdf.fit(df)
    held = [ngrams.counts(x) for x in TEXTS]
    idf = np.log((1 + len(TEXTS)) / (1 + sum((c > 0).astype(int) for c in held))) + 1
    assert np.allclose(model.idf, idf)
    got = {r.example_id: r.embedding for r in model.embed(df).collect()}
    for i, c in enumerate(held):
        assert (got[i] is None) == (not TEXTS[i]) and (got[i] is None or np.allclose(got[i], c * idf / np.linalg.norm(c * idf)))
    assert got[2] == got[3] == got[8]


def test_languages_are_found_in_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = weighting.LanguageModel.fit(docs.where("doc_id % 2 = 0"))
    found = model.identify(docs.where("doc_id % 2 = 1 AND length(text) > 200"))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_found")).cast("int"))).first()[0] > 0.95
    odd = model.identify(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert [(r.lang_found, r.lang_prob, r.lang_odds) for r in odd] == [("unknown", 0.0, None)] * 2


def test_vector_sums_and_labels(spark, vectors, monkeypatch):
    monkeypatch.setattr(weighting, "MOST_KEYS", 1)
    got = {r.label: (r.n, r.embedding) for r in weighting.label_centroids(vectors.where("size(embedding) = 16")).collect()}
    rows = vectors.where("size(embedding) = 16").collect()
    for label in range(4):
        mine = np.array([r.embedding for r in rows if r.label == label])
        assert got[label][0] == len(mine) and np.allclose(got[label][1], mine.mean(axis=0))


def test_prompting_by_threads(spark):
    df = spark.createDataFrame([(str(i), [("user", f"w {i}")]) for i in range(40)], "custom_id string, messages array<struct<role:string,content:string>>")
    tried = {}

    def ask(messages):
        i = int(messages[0]["content"].split()[1])
        tried[i] = tried.get(i, 0) + 1
        if i % 5 == 1 and tried[i] < 3:
            raise backends.RateLimited("later")
        if i % 5 == 2:
            raise ConnectionError("gone")
        if i % 5 == 3:
            raise ValueError("bad")
        return str(i)

    got = {int(r.custom_id): (r.response, r.error, r.tries) for r in backends.Function(ask, 2, wait=lambda n, u, limited: 0.0).answer(df).collect()}
    want = {0: lambda i: (str(i), None, 1), 1: lambda i: (str(i), None, 3), 2: lambda i: (None, "ConnectionError: gone", 3), 3: lambda i: (None, "ValueError: bad", 1), 4: lambda i: (str(i), None, 1)}
    assert got == {i: want[i % 5](i) for i in range(40)}


def test_pace_spreads_calls():
    now, waits = [0.0], []
    pace = backends.Pace(10, waits.append, lambda: now[0])
    for _ in range(3):
        pace.take()
    now[0] = 5.0
    pace.take()
    assert waits == pytest.approx([0.1, 0.2])


def test_keyword_blocks_agree(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "at", "a", "Über", "x.y"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(50)] + [(None, None)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, 3))) for i in range(9)] + [(9, ""), (10, None)], "query_id long, query string")
    rows = lambda n: sorted(map(tuple, retrieve.keyword_top_k(docs, asked, 3, block_queries=n).select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(2) == rows(1000)


def test_asof_join_is_the_plain_one(spark):
    from clauseframe.operators import asof

    rng = random.Random(7)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(200)]
    right = [(i, rng.choice(["a", "a", "c", None]), rng.choice([None, *range(60)])) for i in range(80)]
    l, r = (spark.createDataFrame(x, "i long, k string, t long").repartition(3) for x in (left, right))
    for same in (True, False):
        for splits in (1, 7):
            got = {row.i: row.m and row.m.i for row in asof.asof_join(l, r, ["k"], "t", ["i"], "m", allow_equal=same, splits=splits).collect()}
            want = {}
            for i, k, t in left:
                fit = [(u, j) for j, c, u in right if k is not None and c == k and t is not None and u is not None and (u <= t if same else u < t)]
                want[i] = max(fit)[1] if fit else None
            assert got == want
    none = spark.createDataFrame([], l.schema)
    assert asof.asof_join(none, r, ["k"], "t", ["i"], "m").count() == 0
    assert {row.m for row in asof.asof_join(l, none, ["k"], "t", ["i"], "m").collect()} == {None}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from clauseframe.sources import readers

    lines = ['{"a": %d}' % i if i % 7 else ("" if i % 2 else '{"a": ') for i in range(4000)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.jsonl").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "x" / "2.jsonl").write_text("\n".join(lines[3000:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        good, bad = readers.jsonl_lines(spark, str(tmp_path / "x"), "a int")
        assert sorted((r.line, r.record.a) for r in good.collect()) == [(i + 1, i) for i in range(4000) if i % 7]
        assert sorted((r.line, r.value) for r in bad.collect()) == [(i + 1, '{"a": ') for i in range(0, 4000, 14)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels_by_cosine_repeat_no_vector(spark, vectors, monkeypatch):
    """Like plain numpy, for rows in many blocks, centroids of two widths and a vector without direction; rows stay where they are."""
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 2_000)
    centroids = spark.createDataFrame([(4, [1.0, 2.0]), *((i, [float(x) for x in np.random.default_rng(i % 3).normal(size=16)]) for i in range(4))], "label int, embedding array<double>")
    rows = vectors.where("example_id <> 5")
    known = sorted((r.label, np.array(r.embedding)) for r in centroids.collect())
    want = {}
    for r in rows.where("size(embedding) > 0").collect():
        v = np.array(r.embedding)
        if v.any():
            scores = [(-round(float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), 9), label) for label, c in known if len(c) == len(v)]
            want[r.example_id] = (min(scores)[1] if -min(scores)[0] >= 0.3 else None, -min(scores)[0])
    for limit in ("10m", "-1"):  # sent to all tasks, and met part by part
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            made = weighting.label_by_cosine(rows, centroids, "example_id")
            got = {r.example_id: (r.label, r.cosine) for r in made.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got[703][0] == 0 and np.isnan(got.pop(703)[1])
        assert {i: (label, pytest.approx(c, abs=2e-9)) for i, (label, c) in got.items()} == want
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_tfidf_search_is_the_plain_one_in_parts(spark, monkeypatch):
    """Like the search over embedded texts, for several blocks and parts of both sides; no vector is repeated for a shuffle."""
    monkeypatch.setattr(weighting, "MOST_QUERIES", 7, raising=False)
    monkeypatch.setattr(weighting, "BLOCK_BYTES", 8 * ngrams.BUCKETS * 5)
    texts = [*TEXTS, *(f"{'ab ' * (i % 9)}w{i % 23}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "example_id long, text string").repartition(3)
    asked = docs.where("example_id % 2 = 0").withColumnRenamed("example_id", "query_id")
    model = weighting.TfIdf.fit(docs)
    want = retrieve.top_k(model.embed(asked, keep=["query_id"]), model.embed(docs, keep=["example_id"]), 4, digits=9)
    rows = lambda df: sorted((r.query_id, r["rank"], r.example_id, round(r.score, 8)) for r in df.collect())
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            made = model.top_k(asked, docs, 4, digits=9)
            assert rows(made) == rows(want)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert model.top_k(asked.limit(0), docs, 4).count() == 0 == model.top_k(asked, docs.limit(0), 4).count()

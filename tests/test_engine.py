"""Sources, sinks, retrieval, ledger, stages, runs and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseframe.operators import backends, filters, ledger, prompts, retrieve, stages
from clauseframe.plans import pipeline
from clauseframe.sources import readers, sinks
from clauseframe.streaming import incremental

PASSAGE = "pkg string, idx int, type string, context array<struct<text:string,type:string>>, passage string"


@pytest.fixture
def passages(spark):
    rows = [("a", 0, "text", [("Rights", "h1")], "You have the right to object to processing."), ("a", 1, "text", [], "Hello there."), ("b", 0, "text", [], "Write to our data protection officer: dpo@x.com")]
    return spark.createDataFrame(rows, PASSAGE)


def test_files_in_several_charsets(spark, tmp_path):
    for name, data in {"u.txt": "é".encode(), "w.html": "é".encode("cp1252"), "b.x.txt": b"\xef\xbb\xbfok", "16.txt": "hi".encode("utf-16"), ".hidden": b"no", "e.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.pkg: r.text for r in readers.text_files(spark, str(tmp_path)).collect()} == {"u": "é", "w": "é", "b.x": "ok", "16": "hi"}  # an empty file has no row


def test_policies_by_lines_then_arrays(spark, tmp_path):
    a, b = tmp_path / "lines", tmp_path / "arrays"
    a.mkdir(), b.mkdir()
    row = lambda p: json.dumps({"type": "text", "context": [], "passage": p})
    (a / "x.jsonl").write_text(f"{row('1')}\n\nbroken{{\n{row('2')}\n")
    (b / "x.json").write_text(f"[{row('no')}]")
    (b / "y.json").write_text(f"[{row('3')}, {row('4')}]")
    (b / "z.json").write_text("not json")
    got = sorted((r.pkg, r.idx, r.passage) for r in readers.policies(spark, str(a), str(b)).collect())
    assert got == [("x", 0, "1"), ("x", 1, "2"), ("y", 0, "3"), ("y", 1, "4")]


def test_package_lists(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a.b\n c.d \n\n")
    (tmp_path / "p.csv").write_text("a.b,1\nc.d,2\n")
    for name in ("p.txt", "p.csv"):
        assert [r.pkg for r in readers.package_ids(spark, str(tmp_path / name)).collect()] == ["a.b", "c.d"]


def test_knowledge_base_and_index(spark, tmp_path):
    (tmp_path / "gdpr_req_01.json").write_text(json.dumps({"label": "Controller Name", "gdpr_references": ["Art. 13"], "commentary": "c"}, indent=1))
    (tmp_path / "opp_cat_1.json").write_text(json.dumps({"label": "Data Security", "description": "d", "usage": "u"}))
    assert readers.legal_records(spark, str(tmp_path)).first().gdpr_references == ["Art. 13"]
    assert readers.category_records(spark, str(tmp_path)).first().usage == "u"
    assert [r.file for r in readers.category_files(spark, str(tmp_path)).collect()] == ["opp_cat_1.json"]
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    (tmp_path / "m.json").write_text(json.dumps([{"index": i, "passage": f"p{i}", "example_type": "annotate"} for i in range(3)]))
    made = readers.vector_index(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.json"))
    assert {r.passage: list(r.embedding).index(1.0) for r in made.collect()} == {"p0": 0, "p1": 1, "p2": 2}
    sinks.write_index(made, str(tmp_path / "index"), "m")
    assert sinks.read_index(spark, str(tmp_path / "index")).count() == 3
    info = spark.read.json(str(tmp_path / "index/info")).first()
    assert info.embedding_dimension == 3 and info.total_examples.annotate == 3


def test_appending_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "pkg string, idx int")
    path = str(tmp_path / "t")
    assert sinks.append_stage(df, path, ["pkg", "idx"]) == 2 and sinks.append_stage(df, path, ["pkg", "idx"]) == 0
    assert spark.read.parquet(path).count() == 2
    sinks.write_by_verdict(df.withColumn("verdict", F.lit("accepted")), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v/verdict=accepted")).count() == 3


def test_top_k_is_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4)).round(1)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 3) for i in range(30)], "example_id long, embedding array<double>, label int")
    q = df.where("example_id < 6").select(F.col("example_id").alias("query_id"), "embedding")
    scores = v[:6] @ v.T
    want = {(i, r + 1): j for i in range(6) for r, j in enumerate(sorted(range(30), key=lambda j: (-scores[i, j], j))[:4])}
    assert {(r.query_id, r["rank"]): r.example_id for r in retrieve.top_k(q, df, 4).collect()} == want
    native = retrieve.top_k_relational(q.withColumnRenamed("embedding", "query_embedding"), df, 4)
    assert {(r.query_id, r["rank"]): r.example_id for r in native.collect()} == want


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 7 * 16)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(99, None)], "example_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<double>")
    assert [r.example_id for r in retrieve.top_k(q, df, 3).orderBy("rank").collect()] == [29, 28, 27]


def test_top_k_of_mixed_lengths(spark):
    kind = "example_id long, label string, embedding array<float>"
    rows = [(i, "ab"[i % 2], [float(i), 1.0]) for i in range(6)] + [(6, "a", [9.0, 9.0, 9.0]), (7, "b", None), (8, "a", [])]
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0]), (3, None)], "query_id long, embedding array<float>")
    df = spark.createDataFrame(rows, kind)
    assert sorted((r.query_id, r["rank"], r.example_id) for r in retrieve.top_k(q, df, 2).collect()) == [(0, 1, 5), (0, 2, 4), (1, 1, 6)]
    assert sorted((r.query_id, r.label, r.example_id) for r in retrieve.top_k(q, df, 1, by=["label"]).collect()) == [(0, "a", 4), (0, "b", 5), (1, "a", 6)]
    assert retrieve.top_k(q, df.limit(0), 2).count() == 0


def test_keyword_queries_in_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(12)]
    asked = [(i, " ".join(words[i % 7 : i % 7 + 4]).upper()) for i in range(20)] + [(20, None), (None, "w1 w2"), (21, "w3 w3"), (21, "absent")]
    bodies = [(d, " ".join(words[(d * j) % 12] for j in range(5))) for d in range(15)] + [(15, None)]
    queries, docs = spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(bodies, "doc_id long, text string")
    want = []
    for q in {i for i, _ in asked}:
        texts = [set((x or "").lower().split()) for i, x in asked if i == q]
        got = sorted((-sum(w in (body or "") for w in ws), d) for ws in texts for d, body in bodies)
        want += [(q, d, -s, r) for r, (s, d) in enumerate([x for x in got if x[0]][:3], 1)]
    for most in (retrieve.MOST_QUERIES, 3):
        monkeypatch.setattr(retrieve, "MOST_QUERIES", most)
        assert sorted(map(tuple, retrieve.keyword_top_k(docs, queries, 3).collect()), key=str) == sorted(want, key=str)
    assert retrieve.keyword_top_k(docs, queries.limit(0), 3).count() == 0


def test_few_shots(spark, passages):
    notes = "array<struct<requirement:string,value:string,performed:boolean>>"
    ex = spark.createDataFrame(
        [(0, "text", [], "You have the right to object to processing.", [("Right to Object", "right [...] object", True)], ["Right to Object"]), (1, "text", [], "Something else entirely", [], []), (2, "text", [], "You may object to the processing", [("Right to Object", "object", True), ("Other", "x", False)], ["Right to Object"])],
        f"example_id long, type string, context array<struct<text:string,type:string>>, passage string, annotations {notes}, labels array<string>",
    )
    ex = retrieve.with_embedding(ex, F.col("passage"))
    q = retrieve.with_embedding(passages.withColumn("query_id", F.concat_ws("_", "pkg", "idx")), F.col("passage")).withColumn("labels", F.array(F.lit("Right to Object")))
    similar = {r.query_id: r.fewshots for r in retrieve.similar_fewshots(q, ex).collect()}
    assert json.loads(similar["a_0"][0].user)["passage"].startswith("You have") and "PLACEHOLDER" in similar["a_0"][0].assistant and "a_1" not in similar
    by_label = retrieve.label_fewshots(q, ex)
    shots = {r.query_id: r.fewshots for r in by_label.collect()}
    assert len(shots["a_0"]) == 2
    both = retrieve.combined_fewshots(retrieve.similar_fewshots(q, ex), by_label)
    assert {r.query_id: len(r.fewshots) for r in both.collect()}["a_0"] == len(similar["a_0"]) + 2


def test_curated_examples(spark):
    rows = [(f"p{i}", "R", 0.5 + 0.1 * i, i) for i in range(4)] + [("q", "S", 0.9, 4)]
    static = spark.createDataFrame(rows, "passage string, requirement string, confidence double, ord int")
    asked = spark.createDataFrame([("R",), ("S",)], "requirement string")
    got = retrieve.curated_examples(static, asked, 2, 0.6).orderBy("requirement", "rank").collect()
    assert [r.passage for r in got] == ["p3", "p2", "q"]
    assert {r.requirement: r.n for r in filters.confidence_by_requirement(static).collect()} == {"R": 4, "S": 1}


def test_prompt_folders(spark, tmp_path):
    (tmp_path / "system.md").write_text("say {{RAG_LABELS}}")
    (tmp_path / "response_schema.json").write_text('{"name": "x", "strict": true, "schema": {"type": "object"}}')
    (tmp_path / "example_2_user.json").write_text('{ "a": 1 }')
    (tmp_path / "example_10_user.txt").write_text("ten")
    (tmp_path / "example_2_assistant.json").write_text("[1,\n 2]")
    assert prompts.load_prompts(spark, str(tmp_path)) == ("say {{RAG_LABELS}}", [('{"a": 1}', "[1, 2]"), ("ten", None)], {"type": "object"})
    assert prompts.load_prompts(spark, str(tmp_path / "none")) == (None, [], None)
    table = {r.ord: (r.user, r.assistant) for r in prompts.pair_table(prompts.prompt_files(spark, str(tmp_path))).collect()}
    assert table["10"] == ("ten", None)


def test_answers_of_batches(spark, passages):
    said = F.array(prompts.message("user", F.col("passage")))
    wanted = ledger.requests(passages, "r", "t", "gpt-4o", said)
    ok = lambda i, text, why="stop": (i, None, (200, ([(why, (text,))], (10, 5))))
    from clauseframe.schemas import BATCH_RESPONSE_A, BATCH_RESPONSE_B

    raw = spark.createDataFrame([ok("r_t_a_0", "yes"), ok("r_t_a_1", "cut", "content_filter"), ok("r_t_a_0", "yes")], BATCH_RESPONSE_A)
    got = {r.custom_id: (r.response, r.error) for r in ledger.with_answers(wanted, ledger.answers_a(raw)).collect()}
    assert got == {"r_t_a_0": ("yes", None), "r_t_a_1": (None, "finish reason content_filter"), "r_t_b_0": (None, "missing")}
    other = spark.createDataFrame([("x", ("succeeded", ([("t",)], (1, 2)))), ("y", ("errored", None))], BATCH_RESPONSE_B)
    assert [tuple(r) for r in ledger.answers_b(other).collect()] == [("x", "t", 1, 2, None), ("y", None, None, None, "result errored")]
    assert [r.custom_id for r in ledger.pending(wanted, ledger.answers_a(raw)).collect()] == ["r_t_b_0"]
    calls = spark.createDataFrame([("gpt-4o", 1000, 400, 100), ("none", 5, 0, 5)], "model string, in_tokens long, cached_tokens long, out_tokens long")
    costs = {r.model: r.cost for r in ledger.with_cost(calls, ledger.price_table(spark)).collect()}
    assert costs["gpt-4o"] == pytest.approx(600 * 2.5e-6 + 400 * 0.5e-6 + 100 * 1e-5) and costs["none"] == 0
    assert len(ledger.PRICES) == 29
    lines = wanted.select(ledger.batch_line_a(F.col("custom_id"), F.col("model"), F.col("messages"), 5).alias("value"))
    assert ledger.check_batch(lines).first().ok and not ledger.check_batch(lines.limit(0)).first().ok
    one = json.loads(wanted.select(ledger.batch_line_b(F.col("custom_id"), F.col("model"), F.array(prompts.message("system", F.lit("s")), prompts.message("user", F.lit("u"))), 5)).first()[0])
    assert one["params"]["system"] == "s" and len(one["params"]["messages"]) == 1


class _Echo:
    """A provider that answers each line with its message, batch by batch, and keeps what it was handed."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.handed = spark, folder, []

    def submit(self, path):
        r = self.spark.read.text(path).select(F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>").alias("r"))
        choice = F.struct(F.lit("stop").alias("finish_reason"), F.struct(F.col("r.body.messages")[0]["content"].alias("content")).alias("message"))
        made = r.select("r.custom_id", F.struct(F.lit(200).alias("status_code"), F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))
        made.write.json(f"{self.folder}/{len(self.handed)}")
        self.handed.append(path)
        return str(len(self.handed) - 1)

    def status(self, batch):
        return "completed"

    def results(self, batch):
        return f"{self.folder}/{batch}"


def test_more_than_a_batch_holds_goes_in_several(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("d"), "id").alias("pkg"), F.lit(0).alias("idx"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("text"))
    wanted = ledger.requests(rows, "r", "t", "m", F.array(prompts.message("user", F.col("text"))))
    provider = _Echo(spark, str(tmp_path / "out"))
    got = backends.Batch(str(tmp_path / "in"), provider, most=2000).answer(wanted)
    assert {r.pkg: (r.response, r.error) for r in got.collect()} == {f"d{i}": ("é" * i, None) for i in range(60)}
    sizes = [ledger.check_batch(spark.read.text(p)).first() for p in provider.handed]
    assert len(sizes) > 4 and max(s.n_chars for s in sizes) <= 2000 and sum(s.n_lines for s in sizes) == 60
    with pytest.raises(ValueError, match="60 lines"):
        backends.Batch(str(tmp_path / "long"), provider, most=100).answer(wanted)


def test_stages_with_rules(spark, passages):
    labelled = stages.classify(passages, backends.lexical("classify"))
    got = {(r.pkg, r.idx): r for r in labelled.collect()}
    assert got["a", 0].predicted_labels == ["Right to Object"] and got["a", 1].predicted_labels == [] and "DPO Contact" in got["b", 0].predicted_labels
    noted = stages.targeted_annotate(labelled, backends.lexical("annotate"), system="{{RAG_LABELS}}")
    rows = {(r.pkg, r.idx): r.annotations for r in noted.collect()}
    assert rows["a", 1] == [] and rows["a", 0][0].requirement == "Right to Object"
    again = stages.review(noted, backends.lexical("annotate"))
    assert again.count() == 3
    quality = {(r.pkg, r.idx): (r.n_annotations, r.n_anchored) for r in stages.span_quality(again).collect()}
    assert all(a == b for a, b in quality.values()) and quality["a", 1] == (0, 0)


def test_recorded_answers_lose_nothing(spark, passages):
    answers = spark.createDataFrame([("run_annotate_a_0", '{"annotations": [{"requirement": "Other", "value": "x", "performed": true}, {"requirement": "right to objct", "value": "y", "performed": false}]}', 1, 1, None)], "custom_id string, response string, in_tokens long, out_tokens long, error string")
    got = {(r.pkg, r.idx): [tuple(a) for a in r.annotations] for r in stages.annotate(passages, backends.Replay(answers)).collect()}
    assert got == {("a", 0): [("Right to Object", "y", False)], ("a", 1): [], ("b", 0): []}


def test_detect_and_routes(spark):
    docs = spark.createDataFrame([("a", "privacy personal data"), ("b", "cookies"), ("c", "tea"), ("d", None)], "pkg string, text string")
    got = {r.pkg: r.verdict for r in stages.detect(docs, backends.lexical("detect")).collect()}
    assert got == {"a": "accepted", "b": "unknown", "c": "rejected", "d": "rejected"}


def test_failures_become_rows(spark, passages):
    def ask(messages):
        raise RuntimeError("down")

    wanted = ledger.requests(passages, "r", "t", "m", F.array(prompts.message("user", F.col("passage"))))
    got = backends.Function(ask).answer(wanted).collect()
    assert len(got) == 3 and all(r.error == "RuntimeError: down" and r.response is None for r in got)


def test_runs_and_state(spark, tmp_path):
    pages = spark.createDataFrame([("a", "<main><h1>Privacy</h1><p>We share personal data with service providers; you may withdraw your consent.</p></main>"), ("b", "<main><p>tea</p></main>")], "pkg string, html string")
    seen = []
    state = pipeline.State(notify=lambda s: seen.append((s.status, s.step)))
    got = pipeline.run(spark, pages, pipeline.Config(out=str(tmp_path / "o")), state=state)
    assert {r.pkg for r in got.collect()} == {"a"} and got.where(F.size("annotations") > 0).count() >= 1
    assert state.status == "completed" and state.progress == 1 and ("running", "review") in seen
    config = pipeline.Config.from_json('{"use_opp_115": true, "skip_review": true, "two_step": false, "unknown": 1}')
    assert config.steps() == ["clean", "detect", "parse", "annotate"] and config.scheme == "practices"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a b c", "http://x.com/"), (2, "a b c", "https://sub.x.com/p"), (3, None, "http://y.org")], "doc_id long, text string, url string")
    assert [r.doc_id for r in filters.by_length(df, least=3).collect()] == [1, 2]
    assert [r.doc_id for r in filters.by_domain(df, allowed=["x.com"], denied=["sub.x.com"]).collect()] == [1]
    assert {r.doc_id for r in filters.first_of_equal(df).where("kept").collect()} == {1, 3}
    english = spark.createDataFrame([("the cat is in the house and it was there",), ("zz",)], "text string")
    assert filters.by_language(english).count() == 1


def test_native_stack_is_the_parsers(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.choice(["h1", "h2", "h3", "p"]), f"t{i}") for d in range(5) for i in range(15)]
    got = {(r.d, r.ord): [(c.text, c.type) for c in r.context] for r in filters.context_stack(spark.createDataFrame(rows, "d int, i int, tag string, text string"), "d", "i", "tag", "text").collect()}
    for d in range(5):
        stack = []
        for _, i, tag, text in (r for r in rows if r[0] == d):
            assert got[d, i] == stack
            if tag != "p":
                at = next((k for k, (_, t) in enumerate(stack) if t == tag), None)
                stack = (stack if at is None else stack[:at]) + [(text, tag)]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(i, f"http://h/{i}", f"<main><h1>{i}</h1><p>x</p></main>")], "page_id long, url string, html string").write.mode("append").parquet(str(folder))
    for k in range(2):
        incremental.upsert(incremental.passages_of(incremental.page_stream(spark, str(folder))), str(tmp_path / "out"), ["pkg", "idx"], str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    states = iter(["validating", "in_progress", "expired"])
    assert incremental.wait_for_batch(lambda: next(states), sleep=lambda _: None) == "expired"
    assert incremental.wait_for_batch(lambda: "in_progress", every=10, most=30, sleep=lambda _: None) == "expired"
    now, seen = [0.0], []
    p = incremental.Progress(seen.append, 1.0, lambda: now[0])
    assert p.offer({"n": 1}) and not p.offer({"n": 2})
    now[0] = 1.5
    assert p.offer({"n": 3}) and len(seen) == 2

"""Text functions, answers of models, label vocabularies, languages."""

import pytest
from pyspark.sql import functions as F

from clauseframe.functions import language, llmjson, vocab
from clauseframe.functions import text as X


def plain_excerpt(t):
    w = t.split()
    if len(w) <= 50:
        return t
    start = max(len(w) // 2 - 25, 0)
    return " ".join(w[start : start + 50])


def test_excerpts(spark):
    texts = ["", "a", *(" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 51, 52, 100, 101)), "a b\u0085c\x1cd " * 30, "  lead " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", X.excerpt(F.col("t")).alias("e"), F.size(X.words(F.col("t"))).alias("n")).collect():
        assert r.e == plain_excerpt(texts[r.i]) and r.n == len(texts[r.i].split())


def test_query_and_embedding_texts(spark):
    df = spark.createDataFrame([(1, [("A", "h1"), ("b", "p")], "x"), (2, [], "x"), (3, None, "x")], f"i long, c {X.CONTEXT_DDL}, p string")
    got = {r.i: (r.q, r.e) for r in df.select("i", X.query_text(F.col("c"), F.col("p")).alias("q"), X.embedding_text(F.col("c"), F.col("p")).alias("e")).collect()}
    assert got == {1: ("A; b x", "A b x"), 2: ("x", "x"), 3: ("x", "x")}


def test_urls(spark):
    urls = ["", "  ", "/x", "host/x", "http://h/x", "https://", None]
    df = spark.createDataFrame(list(enumerate(urls)), "i long, u string")
    got = {r.i: r.v for r in df.select("i", X.validated_url(F.col("u"), "store").alias("v")).collect()}
    assert got == {0: None, 1: None, 2: "https://store/x", 3: "https://host/x", 4: "http://h/x", 5: None, 6: None}


def test_templates_placeholders_spans(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(X.fill_template(F.lit("{{RAG_LABELS}}|{{RAG_BACKGROUND}}|{{RAG_LABELS}}"), F.lit("$1"), F.lit("\\b"))) == "$1|\\b|$1"
    assert one(X.replace_placeholders(F.lit("a [...] b[...]"))) == "a PLACEHOLDER bPLACEHOLDER"
    for value, passage, want in [("a PLACEHOLDER c", "x a b\nc y", True), ("c PLACEHOLDER a", "a b c", False), ("b", "a b c", True), ("(a).", "see (a).", True), ("z", "a", False)]:
        assert one(X.spans_anchor(F.lit(value), F.lit(passage))) is want
    assert one(X.custom_id(F.lit("r"), F.lit("t"), F.lit("p"), F.lit(3))) == "r_t_p_3"
    assert one(X.file_stem(F.lit("a.b.txt"))) == "a.b" and one(X.file_stem(F.lit("x"))) == "x"
    assert X.backoff_seconds(10, 1.5) == 30 and X.backoff_seconds(1, 0.5) == 1 and X.backoff_seconds(2, 1, True) == 16
    assert one(X.forwarding_notice(F.lit('<div class="x aXgaGb">'), F.lit(""))) and one(X.forwarding_notice(F.lit(""), F.lit("Click here to CONTINUE"))) and not one(X.forwarding_notice(F.lit("p"), F.lit("q")))


ANSWERS = [
    ('{"labels": ["a", "b"]}', "labels", ["a", "b"]), ('```json\n{"labels": ["a"]}\n```', "labels", ["a"]), ('Sure: {"labels": ["a"]} done', "labels", ["a"]),
    ('{"labels": ["a",]}', "labels", ["a"]), ("{labels: ['a']}", "labels", ["a"]), ('["a"]', "labels", ["a"]), ("{}", "labels", []), ("", "labels", []), (None, "labels", []),
    ('{"other": ["a"]}', "labels", []), ('{"requirements": ["a"]}', None, ["a"]), ("no json", "labels", []), ("[1, 2]", "labels", [1, 2]), ("[" * 5000, "labels", []),
]


@pytest.mark.parametrize(("text", "key", "want"), ANSWERS)
def test_answers(text, key, want):
    assert llmjson.parse_response(text, key) == want


def test_answers_as_columns(spark):
    df = spark.createDataFrame([(i, t) for i, (t, k, _) in enumerate(ANSWERS) if k], "i long, r string")
    got = {r.i: r.x for r in df.select("i", llmjson.label_list(F.col("r")).alias("x")).collect()}
    assert got == {i: [str(w) for w in want] for i, (_, k, want) in enumerate(ANSWERS) if k}
    rows = ['{"annotations": [{"requirement": "A", "value": "v", "performed": true}]}', 'x {"annotations": [{"requirement": "A", "value": "v"},]} y', "none", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, r string")
    got = {r.i: [tuple(a) for a in r.x] for r in df.select("i", llmjson.response_list(F.col("r"), "annotations", "struct<requirement:string,value:string,performed:boolean>").alias("x")).collect()}
    assert got == {0: [("A", "v", True)], 1: [("A", "v", None)], 2: [], 3: []}


def test_label_repair(spark):
    assert len(vocab.labels()) == 21 and len(vocab.labels(vocab.PRACTICES)) == 9
    assert vocab.closest("data storage period", vocab.labels()) == "Data Retention Period" and vocab.closest("", vocab.labels()) is None
    assert vocab.similarity_map("Data Security", vocab.CATEGORIES) == {"Data Security": 1.0}
    df = spark.createDataFrame([(1, ["right to acess", "DPO Contact", None]), (2, []), (3, None)], "i long, l array<string>")
    got = {r.i: r.l for r in vocab.correct_labels(df, "l").collect()}
    assert got == {1: ["Right to Access", "DPO Contact"], 2: [], 3: None}
    notes = spark.createDataFrame([(1, [("rigth to object", "v", True), (None, "w", None)])], "i long, annotations array<struct<requirement:string,value:string,performed:boolean>>")
    got = vocab.correct_annotations(notes).first().annotations
    assert [tuple(a) for a in got] == [("Right to Object", "v", True), ("Unknown", "w", None)]
    kept = notes.select(vocab.drop_other(F.col("annotations")).alias("a"), vocab.distinct_requirements(F.col("annotations")).alias("d")).first()
    assert len(kept.a) == 1 and kept.d == ["rigth to object"]


def test_embedded_repair(spark):
    import numpy as np

    def embed(texts):
        return np.array([[1.0, 0.0] if "Access" in t or t == "see it" else [0.0, 1.0] for t in texts])

    df = spark.createDataFrame([("see it",)], "l string")
    assert vocab.repair_table(df, embed=embed).first().repaired == "Right to Access"


def test_prompt_lines(spark):
    df = spark.createDataFrame([(["DPO Contact", "Nothing"],), ([],)], "l array<string>")
    got = [r.x for r in df.select(vocab.requirement_lines(F.col("l"), vocab.article_map()).alias("x")).collect()]
    assert got == ['"DPO Contact": Article 13(1)(b)\n"Nothing": GDPR', "(No relevant requirements predicted for this passage.)"]


def test_languages(spark):
    df = spark.createDataFrame([("the cat and the dog are in the house",), ("der Hund und die Katze sind in dem Haus",), ("zzz",), ("",), (None,)], "t string")
    got = [r.l.lang for r in df.select(language.language(F.col("t")).alias("l")).collect()]
    assert got[:2] == ["en", "de"] and got[3:] == ["unknown", "unknown"]
    assert language.identify("zzz")[1] < 0.9

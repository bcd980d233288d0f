"""Model stages, few-shots, knowledge and sinks over the given tables: each line of a document is a passage, a rule is the model."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.functions import text as X
from clauseframe.functions import vocab
from clauseframe.operators import backends, ledger, prompts, retrieve, stages
from clauseframe.plans.register import query
from clauseframe.session import table
from clauseframe.sources import sinks

_LINES = """
l AS (SELECT doc_id, i - 1 AS idx, trim(line) AS line, coalesce(source, '') AS source FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')
"""
#: What a rule looks for in a passage, and the label it gives: two are misspelt, one is none of the vocabulary's.
_SIGNS = (("the ", "Right to Access"), ("on", "DPO contact"), ("la ", "Other"), ("as", "Data storage period"), ("re", "Data Categories"))
_RIGHT = {"DPO contact": "DPO Contact", "Data storage period": "Data Retention Period", "Other": None}
_LABELS_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains(line, '{s}') THEN '{_RIGHT.get(x, x)}' END" for s, x in _SIGNS if _RIGHT.get(x, x)) + "], lambda x: x IS NOT NULL)"

_ARTICLES_SQL = ", ".join(f"'{x}': '{vocab.ARTICLES[x]}'" for x in (_RIGHT.get(x, x) for _, x in _SIGNS) if x)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pkg, idx, type, context, passage: the lines of all documents, under their source as a headline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    headline = F.array(F.struct(F.coalesce("source", F.lit("")).alias("text"), F.lit("h1").alias("type")))
    rows = docs.select(F.col("doc_id").cast("string").alias("pkg"), "idx", F.lit("text").alias("type"), headline.alias("context"), F.trim("line").alias("passage"))
    return rows.where("passage <> ''")


def _labelled(passages: DataFrame) -> DataFrame:
    found = F.array(*(F.when(F.contains("passage", F.lit(s)), F.lit(_RIGHT.get(x, x))) for s, x in _SIGNS if _RIGHT.get(x, x)))
    return passages.withColumn("labels", F.array_compact(found))


def _noted(df: DataFrame) -> DataFrame:
    notes = F.transform("annotations", lambda a: F.concat(a["requirement"], F.lit("="), a["value"], F.lit("="), a["performed"].cast("string")))
    return df.select(F.col("pkg").cast("long").alias("doc_id"), "idx", F.array_join(notes, "|").alias("annotations"))


@query(f"WITH {_LINES} SELECT doc_id, idx, array_to_string({_LABELS_SQL}, '|') AS labels FROM l")
def passage_classify(spark, sf_dir):
    """Labels of every line: misspelt ones put right, Other dropped, answers in a code fence read."""

    def rule(messages: list[dict]) -> str:
        said = json.loads(messages[-1]["content"])["passage"]
        return "```json\n" + json.dumps({"labels": [x for s, x in _SIGNS if s in said]}) + "\n```"

    got = stages.classify(_passages(spark, sf_dir), backends.Function(rule), "Name the labels.")
    return got.select(F.col("pkg").cast("long").alias("doc_id"), "idx", F.array_join("predicted_labels", "|").alias("labels"))


@query(f"""
WITH {_LINES} SELECT doc_id, idx, CASE WHEN length(line) % 3 = 0 THEN '' ELSE 'DPO Contact=' || substr(line, 1, 10) || '=' || contains(line, 'the ') END AS annotations FROM l
""")
def passage_annotate(spark, sf_dir):
    """Annotations of every line by a prompt with fixed few-shots; some answers can't be read, and give none."""

    def rule(messages: list[dict]) -> str:
        said = json.loads(messages[-1]["content"])["passage"]
        if len(said) % 3 == 0 or [m["role"] for m in messages] != ["system", "user", "assistant", "user"]:
            return "no idea"
        return json.dumps({"annotations": [{"requirement": "Other", "value": "x", "performed": True}, {"requirement": "DPO contact", "value": said[:10], "performed": "the " in said}]})

    return _noted(stages.annotate(_passages(spark, sf_dir), backends.Function(rule), "Annotate.", [('{"passage":"x"}', '{"annotations":[]}')]))


@query(f"""
WITH {_LINES} SELECT doc_id, idx, array_to_string(list_transform({_LABELS_SQL}, lambda x: x || '=' || substr(line, 1, 5) || '=true'), '|') AS annotations FROM l
""")
def passage_targeted(spark, sf_dir):
    """Annotations for the labels that a line has: the rule reads them from the lines that the template was filled with."""

    def rule(messages: list[dict]) -> str:
        said = json.loads(messages[-1]["content"])["passage"]
        asked = [x.split('"')[1] for x in messages[0]["content"].splitlines() if x.startswith('"') and ": Article " in x]
        return json.dumps({"annotations": [{"requirement": x, "value": said[:5], "performed": True} for x in asked]})

    return _noted(stages.targeted_annotate(_labelled(_passages(spark, sf_dir)), backends.Function(rule), "Only these:\n{{RAG_LABELS}}\n{{RAG_BACKGROUND}}"))


@query(f"""
WITH {_LINES}, k AS (SELECT doc_id, idx, line, {_LABELS_SQL} AS labels FROM l)
SELECT doc_id, idx, CASE WHEN len(labels) = 0 THEN '' ELSE labels[1] || '=' || substr(line, 1, 5) || '=false' END AS annotations, least(len(labels), 1)::BIGINT AS n_annotations, least(len(labels), 1)::BIGINT AS n_anchored FROM k
""")
def passage_review(spark, sf_dir):
    """A second look at every line's annotations keeps those whose value the line has, and says so; values are anchored in their lines."""

    def rule(messages: list[dict]) -> str:
        asked = json.loads(messages[-1]["content"])
        return json.dumps({"annotations": [a | {"performed": False} for a in asked["annotations"] if a["value"] in asked["passage"]]})

    value = lambda i: F.when(i == 0, F.substring("passage", 1, 5)).otherwise(F.lit("\x7f never"))
    before = F.transform("labels", lambda x, i: F.struct(x.alias("requirement"), value(i).alias("value"), F.lit(True).alias("performed")))
    rows = _labelled(_passages(spark, sf_dir)).withColumn("annotations", before).drop("labels")
    got = stages.review(rows, backends.Function(rule), "{{RAG_LABELS}}")
    quality = stages.span_quality(got).select(F.col("pkg").cast("long").alias("doc_id"), "idx", "n_annotations", "n_anchored")
    return _noted(got).join(quality, ["doc_id", "idx"])


@query(f"""
WITH {_LINES} SELECT doc_id, idx, trim(source || ' ' || line) AS embedding_text, source || ' ' || line AS query_text FROM l
""")
def passage_search_texts(spark, sf_dir):
    """What a line is embedded by and searched by."""
    rows = _passages(spark, sf_dir)
    return rows.select(F.col("pkg").cast("long").alias("doc_id"), "idx", X.embedding_text(F.col("context"), F.col("passage")).alias("embedding_text"), X.query_text(F.col("context"), F.col("passage")).alias("query_text"))


@query(f"""
WITH {_LINES}, k AS (SELECT *, {_LABELS_SQL} AS labels FROM l)
SELECT doc_id, idx, 'system,user,assistant,user' AS roles, line AS said, 'For ' || CASE WHEN len(labels) = 0 THEN '{vocab.NO_LABELS}' ELSE
  array_to_string(list_transform(labels, lambda x: '"' || x || '": Article ' || MAP {{{_ARTICLES_SQL}}}[x]), chr(10)) END || ': none' AS asked FROM k
""")
def passage_messages(spark, sf_dir):
    """Message lists of all lines: the system text filled from the labels' articles, a few-shot, the passage."""
    rows = _labelled(_passages(spark, sf_dir))
    system = X.fill_template(F.lit("For {{RAG_LABELS}}: {{RAG_BACKGROUND}}"), vocab.requirement_lines(F.col("labels"), vocab.article_map()), F.lit("none"))
    listed = prompts.messages(system, prompts.static_fewshots([("u", "a")]), F.col("passage"))
    made = rows.select(F.col("pkg").cast("long").alias("doc_id"), "idx", listed.alias("m"))
    return made.select("doc_id", "idx", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.element_at("m", -1)["content"].alias("said"), F.element_at("m", 1)["content"].alias("asked"))


# ---- few-shots and knowledge -------------------------------------------------------------------------------------

_HITS = """
WITH s AS (SELECT q.vec_id AS query_id, q.label AS asked, e.vec_id AS example_id, e.label, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s
           FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, example_id) AS rank FROM s QUALIFY rank <= 4),
p AS (SELECT query_id, rank, '{"type":"text","context":[],"passage":"p ' || example_id || ' PLACEHOLDER"}' AS user,
      '{"annotations":[{"requirement":"L' || label || '","value":"v ' || example_id || '","performed":true}]}' AS assistant FROM h WHERE s >= 0.3)
"""


def _shots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    name = lambda n: F.concat(F.lit("L"), n.cast("string"))
    note = F.struct(name(F.col("label")).alias("requirement"), F.concat(F.lit("v "), "vec_id").alias("value"), F.lit(True).alias("performed"))
    examples = vectors.select(F.col("vec_id").alias("example_id"), F.lit("text").alias("type"), F.array().cast(X.CONTEXT_DDL).alias("context"), F.concat(F.lit("p "), "vec_id", F.lit(" [...]")).alias("passage"), F.array(note).alias("annotations"), F.array(name(F.col("label"))).alias("labels"), "embedding")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.array(name((F.col("label") + 1) % 10), name(F.col("label"))).alias("labels"))
    return asked, examples


@query(_HITS + "SELECT query_id, rank, p.user, assistant FROM p WHERE rank <= 3")
def vec_similar_fewshots(spark, sf_dir):
    """The three most similar examples above a score, as few-shots."""
    asked, examples = _shots(spark, sf_dir)
    shots = retrieve.similar_fewshots(asked, examples, 3, 0.3)
    return shots.select("query_id", F.explode("fewshots").alias("s")).select("query_id", "s.rank", "s.user", "s.assistant")


@query(_HITS + """, u AS (
  SELECT query_id, 0 AS part, rank, p.user, assistant FROM p WHERE rank <= 3
  UNION ALL SELECT query_id, part, rank, p.user, assistant FROM p, (VALUES (1), (2)) t(part) WHERE rank <= 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1 AS place, u.user, assistant FROM u""")
def vec_combined_fewshots(spark, sf_dir):
    """Similar examples, then two for each label of the asking row, in the order of its labels; repeats stay."""
    asked, examples = _shots(spark, sf_dir)
    both = retrieve.combined_fewshots(retrieve.similar_fewshots(asked, examples, 3, 0.3), retrieve.label_fewshots(asked, examples, 2, 0.3))
    return both.select("query_id", F.posexplode("fewshots").alias("place", "s")).select("query_id", "place", "s.user", "s.assistant")


@query("""
SELECT s_suppkey, '### ' || n_name || ':' || chr(10) || 'GDPR References: ' || r_name || chr(10) || chr(10) || 'Commentary: key ' || n_nationkey AS background
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def label_background(spark, sf_dir):
    """What a knowledge base of nations says of each supplier's labels; one that it doesn't know is left out."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = nations.select(F.col("n_name").alias("label"), F.array("r_name").alias("references"), F.concat(F.lit("key "), "n_nationkey").alias("commentary"))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array(F.lit("Nowhere"), "n_name").alias("labels"))
    return retrieve.background(rows, known, vocab.background_text(F.col("label"), F.col("references"), F.col("commentary"))).select("s_suppkey", "background")


@query("""
SELECT s_suppkey, '### ' || n_name || ':' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'Description: ' || r_name || chr(10) || chr(10) ELSE '' END || 'Usage Guidelines: key ' || n_nationkey AS background
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def category_background(spark, sf_dir):
    """The same from a base of categories, some without a description."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    about = F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.lit(""))
    known = nations.select(F.col("n_name").alias("label"), about.alias("description"), F.concat(F.lit("key "), "n_nationkey").alias("usage"))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array("n_name").alias("labels"))
    return retrieve.background(rows, known, vocab.category_text(F.col("label"), F.col("description"), F.col("usage"))).select("s_suppkey", "background")


@query("""
WITH r AS (SELECT DISTINCT lower(substr(c_mktsegment, 2, 4)) AS requirement FROM customer)
SELECT requirement, c_mktsegment AS label, c_custkey FROM customer JOIN r ON contains(lower(c_mktsegment), requirement)
""")
def requirement_examples(spark, sf_dir):
    """Customers as examples labelled by segment, met by requirements that a label contains."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array("c_mktsegment").alias("labels"))
    asked = rows.select(F.lower(F.substring(F.col("labels")[0], 2, 4)).alias("requirement"))
    return retrieve.examples_for_requirements(rows, asked).select("requirement", "label", "c_custkey")


# ---- batches and sinks -------------------------------------------------------------------------------------------


class _Provider:
    """A provider whose batches are a Spark job: of a line's message its length; some answers are cut off, some never come, and results lie in two folders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.states: dict[str, Iterator[str]] = {}

    def submit(self, path: str) -> str:
        lines = self.spark.read.text(path).select(F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>").alias("r"))
        n = F.coalesce(F.length(F.element_at("r.body.messages", -1)["content"]), F.lit(0))
        choice = F.struct(F.when(n % 5 == 1, "content_filter").otherwise("stop").alias("finish_reason"), F.struct(n.cast("string").alias("content")).alias("message"))
        body = F.struct(F.array(choice).alias("choices"), F.struct(n.cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens")).alias("usage"))
        made = lines.select("r.custom_id", F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"), n.alias("n"))
        batch = f"batch-{len(self.states)}"
        self.states[batch] = iter(["validating", "in_progress", "completed"])
        sinks.write_jsonl(made.where("n % 7 <> 3 AND n % 2 = 0").drop("n"), f"{self.folder}/{batch}/1")
        sinks.write_jsonl(made.where("n % 7 <> 3 AND n % 2 = 1").drop("n"), f"{self.folder}/{batch}/2")
        return batch

    def status(self, batch: str) -> str:
        return next(self.states[batch])

    def results(self, batch: str) -> str:
        return f"{self.folder}/{batch}/*"


@query("""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)
SELECT 'run_detect_' || doc_id || '_0' AS custom_id, CASE WHEN n % 7 <> 3 AND n % 5 <> 1 THEN n::VARCHAR END AS response,
       CASE WHEN n % 7 = 3 THEN 'missing' WHEN n % 5 = 1 THEN 'finish reason content_filter' END AS error FROM n
""")
def batch_round_trip(spark, sf_dir):
    """All documents through a provider's batches: lines written and guarded, handed in, waited for, results of two folders joined by id."""
    top = f"{sinks.scratch_folder(spark)}/batch-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pkg"), F.lit(0).alias("idx"), "text")
    wanted = ledger.requests(docs, "run", "detect", "gpt-4o", F.array(prompts.message("user", F.coalesce("text", F.lit("")))))
    return backends.Batch(f"{top}/in", _Provider(spark, f"{top}/out"), sleep=lambda _: None).answer(wanted).select("custom_id", "response", "error")


@query("""
SELECT 'verdict' AS sink, CASE n_chars % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'unknown' ELSE 'rejected' END AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 2
UNION ALL SELECT 'language', lang, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY lang
""")
def routed_sinks(spark, sf_dir):
    """Documents routed to folders by verdict and by language, written twice over, and read back by their folders."""
    top = f"{sinks.scratch_folder(spark)}/routed-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").withColumn("verdict", F.when(F.col("n_chars") % 3 == 0, "accepted").when(F.col("n_chars") % 3 == 1, "unknown").otherwise("rejected")).withColumn("lang_bucket", F.col("lang"))
    for _ in range(2):
        sinks.write_by_verdict(docs, f"{top}/verdict")
        sinks.write_by_language(docs, f"{top}/language")
    count = lambda name, part: spark.read.parquet(f"{top}/{name}").groupBy(F.lit(name).alias("sink"), F.col(part).alias("part")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return count("verdict", "verdict").unionByName(count("language", "lang_bucket"))


@query("""
SELECT any_value(len(embedding))::INTEGER AS embedding_dimension, count(*) FILTER (label % 2 = 0)::INTEGER AS annotate, count(*) FILTER (label % 2 = 1)::INTEGER AS classify, count(*) AS n_read, round(sum(embedding[1]), 3) AS firsts FROM embeddings
""")
def index_round_trip(spark, sf_dir):
    """An example index written and read back, beside the row that says what it holds."""
    top = f"{sinks.scratch_folder(spark)}/index-{uuid.uuid4().hex}"
    examples = table(spark, sf_dir, "embeddings").withColumn("example_type", F.when(F.col("label") % 2 == 0, "annotate").otherwise("classify"))
    sinks.write_index(examples, top, "hashed")
    read = sinks.read_index(spark, top).agg(F.count("*").alias("n_read"), F.round(F.sum(F.col("embedding")[0].cast("double")), 3).alias("firsts"))
    info = spark.read.json(f"{top}/info").select(F.col("embedding_dimension").cast("int").alias("embedding_dimension"), F.col("total_examples.annotate").cast("int").alias("annotate"), F.col("total_examples.classify").cast("int").alias("classify"))
    return info.join(read, F.lit(True))  # one row each

"""Label vocabularies of both annotation schemes, and repair of labels that aren't in them."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSPARENCY, PRACTICES = "transparency", "practices"
#: Labels of the transparency scheme with the article that asks for each.
ARTICLES = {
    "Controller Name": "13(1)(a)", "Controller Contact": "13(1)(a)", "DPO Contact": "13(1)(b)", "Data Categories": "14(1)(d)", "Processing Purpose": "13(1)(c)",
    "Legal Basis for Processing": "13(1)(c)", "Legitimate Interests for Processing": "13(1)(d)", "Source of Data": "14(2)(f)", "Data Retention Period": "13(2)(a)",
    "Data Recipients": "13(1)(e)", "Third-country Transfers": "13(1)(f)", "Mandatory Data Disclosure": "13(2)(e)", "Automated Decision-Making": "13(2)(f)",
    "Right to Access": "13(2)(b)", "Right to Rectification": "13(2)(b)", "Right to Erasure": "13(2)(b)", "Right to Restrict": "13(2)(b)", "Right to Object": "13(2)(b)",
    "Right to Portability": "13(2)(b)", "Right to Withdraw Consent": "13(2)(c)", "Right to Lodge Complaint": "13(2)(d)",
}
NO_ARTICLE = "GDPR"
#: Labels of the privacy-practice scheme.
CATEGORIES = [
    "First Party Collection/Use", "Third Party Sharing/Collection", "User Choice/Control", "User Access, Edit and Deletion", "Data Retention", "Data Security",
    "Policy Change", "Do Not Track", "International and Specific Audiences",
]
UNKNOWN, OTHER = "Unknown", "Other"
#: Fixed value: what a prompt says of a passage without labels.
NO_LABELS = "(No relevant requirements predicted for this passage.)"
#: Least cosine at which an embedded label counts as repaired.
LEAST_COSINE = 0.3


def labels(scheme: str = TRANSPARENCY) -> list[str]:
    return list(ARTICLES) if scheme == TRANSPARENCY else CATEGORIES


def label_table(spark: SparkSession, scheme: str = TRANSPARENCY) -> DataFrame:
    """label, reference, ord: at most 21 rows, fit to be broadcast."""
    rows = [(x, ARTICLES.get(x, NO_ARTICLE), i) for i, x in enumerate(labels(scheme))]
    return spark.createDataFrame(rows, "label string, reference string, ord int")


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks, upper case as lower."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def closest(label: str, vocabulary: list[str]) -> str | None:
    """The label with the largest ratio, the first of equals; none if no ratio is above 0."""
    ratio, _, label = max(((similarity(label, v), -i, v) for i, v in enumerate(vocabulary)), default=(0.0, 0, None))
    return label if ratio > 0 else None


def similarity_map(label: str, vocabulary: list[str]) -> dict[str, float]:
    return {label: 1.0} if label in vocabulary else {v: similarity(label, v) for v in vocabulary}


Embed = Callable[[list[str]], np.ndarray]


def repair_table(found: DataFrame, scheme: str = TRANSPARENCY, embed: Embed | None = None) -> DataFrame:
    """(label, repaired, method) for the distinct labels of a column that the vocabulary doesn't have.

    With an embedder the closest vocabulary label by cosine is taken if it is close enough; else, and without one, the one
    with the most matching blocks.
    """
    known = labels(scheme)
    wrong = found.select(F.col(found.columns[0]).alias("label")).where("label IS NOT NULL").where(~F.col("label").isin(known)).distinct()

    def run(batches):
        vectors = embed(known) if embed else None
        for b in batches:
            out = []
            for x in b["label"]:
                hit = method = None
                if vectors is not None:
                    scores = vectors @ embed([x])[0]
                    at = int(np.argmax(scores))
                    hit, method = (known[at], "embedding") if scores[at] > LEAST_COSINE else (None, None)
                out.append((x, hit or closest(x, known) or UNKNOWN, method or "ratio"))
            yield pd.DataFrame(out, columns=["label", "repaired", "method"])

    return wrong.mapInPandas(run, "label string, repaired string, method string")


def _with_repairs(df: DataFrame, label: Column, scheme: str, embed: Embed | None) -> DataFrame:
    """The table with ``__fix``, a map of the row's wrong labels to the right ones, null where none is wrong.

    Only rows with a wrong label are shuffled; these are keyed by their wrong labels, so equal ones share a row of the map.
    """
    wrong = F.array_sort(F.array_distinct(F.filter(label, lambda x: x.isNotNull() & ~x.isin(labels(scheme)))))
    keyed = df.withColumn("__wrong", F.when(F.size(wrong) > 0, wrong)).withColumn("__key", F.when(F.col("__wrong").isNotNull(), F.sha2(F.to_json("__wrong"), 256)))
    bad = keyed.where("__key IS NOT NULL")
    each = bad.select("__key", F.explode("__wrong").alias("label")).distinct()
    fixed = each.join(repair_table(each.select("label"), scheme, embed), "label").groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("label", "repaired"))).alias("__fix"))
    right = keyed.where("__key IS NULL").withColumn("__fix", F.lit(None).cast("map<string,string>"))
    return bad.join(fixed, "__key", "left").select(*keyed.columns, "__fix").unionByName(right).drop("__wrong")


def correct_labels(df: DataFrame, column: str, scheme: str = TRANSPARENCY, embed: Embed | None = None) -> DataFrame:
    """Labels of an array column put right: known ones stay, nulls and Other go, others become their closest."""
    named = F.filter(F.col(column), lambda x: x.isNotNull() & (x != OTHER))
    got = _with_repairs(df, named, scheme, embed)
    right = F.transform(named, lambda x: F.coalesce(F.col("__fix")[x], x))  # a null map gives null
    return got.withColumn(column, right).drop("__key", "__fix")


def correct_annotations(df: DataFrame, column: str = "annotations", scheme: str = TRANSPARENCY, embed: Embed | None = None) -> DataFrame:
    """The requirements of annotations put right; a null one becomes Unknown."""
    got = _with_repairs(df, F.transform(F.col(column), lambda a: a["requirement"]), scheme, embed)
    right = F.transform(
        F.col(column),
        lambda a: F.struct(F.coalesce(F.col("__fix")[F.coalesce(a["requirement"], F.lit(""))], a["requirement"], F.lit(UNKNOWN)).alias("requirement"), a["value"].alias("value"), a["performed"].alias("performed")),
    )
    return got.withColumn(column, right).drop("__key", "__fix")


def drop_other(annotations: Column) -> Column:
    """Without annotations of no requirement, or of the label Other."""
    return F.filter(annotations, lambda a: a["requirement"].isNotNull() & (a["requirement"] != OTHER))


def distinct_requirements(annotations: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(annotations, lambda a: a["requirement"]), lambda x: x.isNotNull())))


def requirement_lines(requirements: Column, references: Column) -> Column:
    """One line for each requirement: its name in quotes and its article. references: a map."""
    lines = F.transform(requirements, lambda r: F.concat(F.lit('"'), r, F.lit('": '), F.coalesce(F.concat(F.lit("Article "), references[r]), F.lit(NO_ARTICLE))))
    return F.when(F.coalesce(F.size(requirements), F.lit(0)) == 0, F.lit(NO_LABELS)).otherwise(F.array_join(lines, "\n"))


def article_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in ARTICLES.items() for x in pair))


def background_text(label: Column, references: Column, commentary: Column) -> Column:
    """What a prompt says of a label: its references and commentary, those that there are; else that there is nothing."""
    listed = F.when(F.size(references) > 0, F.concat(F.lit("GDPR References: "), F.array_join(references, ", ")))
    return _about(label, listed, F.when(commentary != "", F.concat(F.lit("Commentary: "), commentary)))


def _about(label: Column, *parts: Column) -> Column:
    said = F.concat_ws("\n\n", *parts)
    missing = F.concat(F.lit("Legal background for "), label, F.lit(" not available."))  # fixed value
    return F.concat(F.lit("### "), label, F.lit(":\n"), F.when(said != "", said).otherwise(missing))


def category_text(label: Column, description: Column, usage: Column) -> Column:
    """The same of a category: its description and how to use it."""
    return _about(label, F.when(description != "", F.concat(F.lit("Description: "), description)), F.when(usage != "", F.concat(F.lit("Usage Guidelines: "), usage)))

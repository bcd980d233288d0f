"""Readers: stage folders, policies, package lists, knowledge bases, example corpora, vector indexes, provider results."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.sources.sinks import scratch_folder
from clauseframe import schemas as S
from clauseframe.functions.text import file_stem


#: Passage, requirement, value, performed, confidence, source.
CURATED = [
    ("We collect your email address, phone number, and postal address for account management.", "Data Categories", "email address", True, 0.95, "example_policy_1"),
    ("Your device identifiers, IP address, and browser information are collected for analytics.", "Data Categories", "device identifiers", True, 0.92, "example_policy_2"),
    ("We do not collect sensitive personal data such as health information or financial records.", "Data Categories", "sensitive personal data", False, 0.88, "example_policy_3"),
    ("Your data is used to provide customer support and respond to your inquiries.", "Processing Purpose", "provide customer support", True, 0.94, "example_policy_1"),
    ("We process your information to improve our services and develop new features.", "Processing Purpose", "improve our services", True, 0.91, "example_policy_2"),
    ("Your data is used for marketing purposes, including sending promotional emails.", "Processing Purpose", "marketing purposes", True, 0.89, "example_policy_4"),
    ("We process your data based on your explicit consent for marketing communications.", "Legal Basis for Processing", "your explicit consent", True, 0.96, "example_policy_1"),
    ("Data processing is necessary for the performance of our service contract with you.", "Legal Basis for Processing", "performance of our service contract", True, 0.93, "example_policy_2"),
    ("We rely on legitimate interests to process data for fraud prevention.", "Legal Basis for Processing", "legitimate interests", True, 0.90, "example_policy_3"),
    ("You have the right to request access to all personal data we hold about you.", "Right to Access", "right to request access", True, 0.95, "example_policy_1"),
    ("You may request a copy of your personal data by contacting our data protection officer.", "Right to Access", "request a copy of your personal data", True, 0.92, "example_policy_2"),
    ("We will provide you with access to your data within 30 days of your request.", "Right to Access", "within 30 days of your request", True, 0.88, "example_policy_3"),
    ("We retain your personal data for 3 years after your last interaction with us.", "Data Retention Period", "3 years after your last interaction", True, 0.94, "example_policy_1"),
    ("Account data is kept for 7 years to comply with legal obligations.", "Data Retention Period", "7 years to comply with legal obligations", True, 0.91, "example_policy_2"),
    ("Marketing data is retained until you withdraw your consent.", "Data Retention Period", "until you withdraw your consent", True, 0.89, "example_policy_4"),
    ("You have the right to request deletion of your personal data at any time.", "Right to Erasure", "right to request deletion", True, 0.95, "example_policy_1"),
    ("We will delete your data upon request, subject to legal retention requirements.", "Right to Erasure", "delete your data upon request", True, 0.92, "example_policy_2"),
    ("You can request erasure by contacting our support team or using the account settings.", "Right to Erasure", "request erasure by contacting our support team", True, 0.88, "example_policy_3"),
]


def _name() -> Column:
    return F.regexp_extract(F.col("path"), r"([^/]+)$", 1)


def decode_bytes(content: bytes | None) -> str | None:
    """Text of a file in the charset that it seems to have."""
    return None if content is None else content.decode(charset_of(content), "replace")


def charset_of(content: bytes) -> str:
    """By the byte order mark; else UTF-16 by the zero bytes of its plain letters, UTF-8 if it is valid, Windows-1251 if the
    bytes beyond ASCII look like words of it, a charset of East Asia if it is valid and most of its wide characters are common
    letters there; else Windows-1252."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return charset
    even, odd = content[0::2].count(0), content[1::2].count(0)
    if max(even, odd) > len(content) // 5:
        return "utf-16-le" if odd > even else "utf-16-be"
    if _valid(content, "utf-8") is not None:
        return "utf-8"
    high = re.findall(rb"[\x80-\xff]+", content)
    if (most := sum(map(len, high))) >= 8:
        # In Windows-1251 the small letters are the bytes from 0xe0 on, and capitals begin words.
        small = sum(len(re.sub(rb"^[\xc0-\xdf]|[\xe0-\xff]", b"", h)) for h in high)
        if small < 0.1 * most and sum(len(h) for h in high if len(h) > 2) > 0.8 * most:
            return "cp1251"
        for charset, common in _WIDE:
            text = _valid(content, charset)
            wide = [c for c in text or "" if c > "\x7f"]
            if wide and sum(bool(common.match(c)) for c in wide) > 0.9 * len(wide):
                return charset
    return "cp1252"


def _valid(content: bytes, charset: str) -> str | None:
    try:
        return content.decode(charset)
    except UnicodeDecodeError:
        return None


#: Charsets with characters of two bytes, and the letters that make up most texts in them.
_WIDE = [
    ("shift_jis", re.compile("[\u3040-\u30ff\u3000-\u303f\u4e00-\u9fff\uff01-\uff60]")), ("euc_kr", re.compile("[\uac00-\ud7a3\u3000-\u303f]")), ("euc_jp", re.compile("[\u3040-\u30ff\u3000-\u303f\u4e00-\u9fff\uff01-\uff60]")),
    ("gb18030", re.compile("[\u4e00-\u9fff\u3000-\u303f\uff01-\uff60]")), ("big5", re.compile("[\u4e00-\u9fff\u3000-\u303f\uff01-\uff60]")),
]


def stage_files(spark: SparkSession, folder: str) -> DataFrame:
    """pkg (the file's stem), content, of all files that aren't hidden; Spark gives no row for a file of no bytes."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(~_name().startswith(".")).select(file_stem(_name()).alias("pkg"), "content")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """pkg, text: whole files, each in the charset that it seems to have."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(decode_bytes)

    return stage_files(spark, folder).select("pkg", decode("content").alias("text"))


def json_documents(spark: SparkSession, folder: str, schema: T.DataType) -> DataFrame:
    """pkg, record: one JSON value a file; null where a file holds none."""
    element = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    return text_files(spark, folder).select("pkg", element.alias("record"))


def policy_json(spark: SparkSession, folder: str) -> DataFrame:
    """pkg, idx and the columns of a passage row, of files that hold an array of them."""
    got = json_documents(spark, folder, T.ArrayType(S.POLICY_ROW))
    return got.select("pkg", F.posexplode("record").alias("idx", "r")).select("pkg", "idx", "r.*")


def policy_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """The same of files with a row a line, in the order of the lines; blank and broken lines are passed over."""
    lines = text_files(spark, folder).select("pkg", F.posexplode(F.split("text", "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    kept = lines.withColumn("r", F.from_json("value", S.POLICY_ROW, {"mode": "PERMISSIVE"})).where("r.passage IS NOT NULL OR r.type IS NOT NULL")
    place = F.array_position(F.col("__lines"), F.col("line")) - 1
    order = kept.groupBy("pkg").agg(F.sort_array(F.collect_list("line")).alias("__lines"))
    return kept.join(order, "pkg").select("pkg", place.cast("int").alias("idx"), "r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, value: the lines of text files of any size, numbered from 1 in the order of the files' names and of their lines.

    Files are read split by split, in parallel. A split's lines have consecutive numbers where they are read; what is added
    to them is the sum of the lines of all splits before it, a row for each split. The lines are written to the shared
    folder once, so that a task that runs again finds the same numbers.
    """
    split = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    read = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("id"), "value")
    top = f"{scratch_folder(spark)}/lines-{uuid.uuid4().hex}"
    read.write.parquet(top)
    held = spark.read.schema(read.schema).parquet(top)
    sizes = held.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    shifts = sizes.select("path", "start", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return held.join(shifts, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def jsonl_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Files with a JSON value a line: (path, line, record), and apart from them (path, line, value) of the lines that aren't one. Blank
    lines are in neither, and count as lines."""
    whole = T.StructType([*T._parse_datatype_string(schema), T.StructField("__bad", T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    read = lines.withColumn("record", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("record.__bad").isNotNull() | F.col("record").isNull()
    return read.where(~bad).select("path", "line", F.col("record").dropFields("__bad").alias("record")), read.where(bad).select("path", "line", "value")


def policies(spark: SparkSession, jsonl_folder: str, json_folder: str) -> DataFrame:
    """Line files first; array files for packages that have none."""
    lines = policy_jsonl(spark, jsonl_folder)
    return lines.unionByName(policy_json(spark, json_folder).join(lines.select("pkg").distinct(), "pkg", "left_anti"))


def package_ids(spark: SparkSession, path: str) -> DataFrame:
    """pkg: the first column of a .csv file, else the lines of a text file, stripped."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=False).select(F.trim("_c0").alias("pkg")).where("pkg <> ''")
    return spark.read.text(path).select(F.trim("value").alias("pkg")).where("pkg <> ''")


def one_package(spark: SparkSession, pkg: str) -> DataFrame:
    return spark.createDataFrame([(pkg,)], "pkg string")


def page_documents(spark: SparkSession, path: str) -> DataFrame:
    """pkg, url, html of a table of pages that were fetched before."""
    return spark.read.parquet(path).select(F.col("page_id").cast("string").alias("pkg"), "url", "html")


def _one_json(spark: SparkSession, schema: T.StructType, *paths: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(list(paths))


def legal_index(spark: SparkSession, path: str) -> DataFrame:
    return _one_json(spark, S.LEGAL_INDEX, path).select(F.explode("requirements_overview").alias("r")).select("r.*")


def category_index(spark: SparkSession, path: str) -> DataFrame:
    return _one_json(spark, S.CATEGORY_INDEX, path).select(F.explode("categories_overview").alias("r")).select("r.*")


def legal_records(spark: SparkSession, folder: str, glob: str = "gdpr_req_*.json") -> DataFrame:
    """One row a label: the knowledge base, a few dozen rows. Of several files with one label the first by name counts."""
    return _first_by_file(_one_json(spark, S.LEGAL_RECORD, folder, glob=glob))


def category_records(spark: SparkSession, folder: str, glob: str = "opp_cat_*.json") -> DataFrame:
    return _first_by_file(_one_json(spark, S.CATEGORY_RECORD, folder, glob=glob))


def _first_by_file(records: DataFrame) -> DataFrame:
    row = F.struct(*records.columns)
    first = records.where("label IS NOT NULL").groupBy("label").agg(F.min_by(row, F.col("_metadata.file_path")).alias("r"))
    return first.select("r.*")


def fallback_examples(spark: SparkSession) -> DataFrame:
    """The curated examples that serve where no example index is at hand, with ``ord``, their order."""
    rows = [(*r[:4], float(r[4]), r[5], "normal", i) for i, r in enumerate(CURATED)]
    return spark.createDataFrame(rows, T.StructType([*S.STATIC_EXAMPLE, T.StructField("ord", T.IntegerType())]))


def category_files(spark: SparkSession, folder: str, glob: str = "opp_cat_*.json") -> DataFrame:
    """Names of the knowledge base's files, sorted."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(_name().alias("file")).orderBy("file")


def example_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotated examples from an array file, or from lines (broken ones passed over)."""
    schema = T.StructType([f for f in S.EXAMPLE if f.name in ("type", "context", "passage", "annotations", "labels")])
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def vector_index(spark: SparkSession, matrix_path: str, metadata_path: str) -> DataFrame:
    """Metadata rows with their vectors from a .npy matrix, met by position."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(m), 5000):
                    yield pd.DataFrame({"index": np.arange(i, min(i + 5000, len(m)), dtype=np.int32), "embedding": list(m[i : i + 5000].astype(np.float32))})

    vectors = spark.read.format("binaryFile").load(matrix_path).select("content").mapInPandas(rows, "index int, embedding array<float>")
    schema = T.StructType([f for f in S.EXAMPLE if f.name != "embedding"])
    return spark.read.schema(schema).option("multiLine", True).json(metadata_path).join(vectors, "index")


def batch_results(spark: SparkSession, path: str | list[str], provider: str = "a") -> DataFrame:
    return spark.read.schema(S.BATCH_RESPONSE_A if provider == "a" else S.BATCH_RESPONSE_B).option("mode", "DROPMALFORMED").json(path)


def recorded_answers(spark: SparkSession, path: str | list[str], provider: str = "a") -> DataFrame:
    """custom_id, response, in_tokens, out_tokens, error from a provider's result files."""
    from clauseframe.operators import ledger

    raw = batch_results(spark, path, provider)
    return ledger.answers_a(raw) if provider == "a" else ledger.answers_b(raw)

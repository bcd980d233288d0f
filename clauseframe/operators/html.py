"""Page operators: one Arrow batch in, one out; the tree never leaves the call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clauseframe.functions import clean, store
from clauseframe.functions.passages import parse_passages
from clauseframe.schemas import APP_METADATA, PASSAGE

#: Pages worked on between two outputs.
PAGES = 64


def _column(df: DataFrame, html_col: str, name: str, kind: T.DataType, work: Callable[[str | None], object]) -> DataFrame:
    """The table with one more column, from its HTML; all others go along untouched."""
    rest = [c for c in df.columns if c != name]
    out = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, kind)])
    arrow, at = to_arrow_type(kind), rest.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, PAGES):
                b = whole.slice(i, PAGES)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([work(x) for x in b.column(at).to_pylist()], arrow)], names=out.fieldNames())

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, out)


def with_clean_html(df: DataFrame, html_col: str = "html", name: str = "cleaned_html") -> DataFrame:
    return _column(df, html_col, name, T.StringType(), clean.clean_html)


def with_text(df: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """The visible text of each page."""
    return _column(df, html_col, name, T.StringType(), clean.visible_text)


def with_main_content(df: DataFrame, html_col: str = "html", name: str = "main_html") -> DataFrame:
    return _column(df, html_col, name, T.StringType(), clean.main_content)


def with_store_metadata(df: DataFrame, html_col: str = "html", name: str = "metadata", classes: dict[str, str] = store.CLASSES) -> DataFrame:
    empty = dict.fromkeys(APP_METADATA.fieldNames())
    return _column(df, html_col, name, APP_METADATA, lambda x: empty | store.parse_store_page(x, classes))


def _rows(html: str | None) -> list[dict]:
    return [
        {"idx": i, "type": kind, "context": [{"text": t, "type": k} for t, k in context], "passage": text} for i, (kind, context, text) in enumerate(parse_passages(html))
    ]


def passages(df: DataFrame, key_cols: list[str], html_col: str = "cleaned_html") -> DataFrame:
    """One row a passage: the keys, ``idx`` (its place in the document), ``type``, ``context``, ``passage``.

    State starts anew with every document, so partitioning changes nothing.
    """
    parsed = _column(df.select(*key_cols, html_col), html_col, "__passages", T.ArrayType(PASSAGE), _rows)
    return parsed.select(*key_cols, F.explode("__passages").alias("p")).select(*key_cols, "p.idx", "p.type", "p.context", "p.passage")


@F.udtf(returnType="idx int, type string, context array<struct<text:string,type:string>>, passage string")
class PassagesOf:
    """Passages of one cleaned page, as a table function: for SQL, where a page is a lateral argument."""

    def eval(self, cleaned_html: str):
        for r in _rows(cleaned_html):
            yield r["idx"], r["type"], r["context"], r["passage"]


def register(spark: SparkSession, name: str = "passages_of") -> None:
    """Let SQL call ``passages_of(html)``."""
    spark.udtf.register(name, PassagesOf)

"""Text functions as Spark expressions: excerpts, normal forms, URLs, verdict-free predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"
EXCERPT_WORDS = 50
#: What a page says that only forwards.
FORWARDING = ("forwarding", "redirect", "you are being redirected", "click here to continue", "proceed to")
FORWARDING_CLASS = "aXgaGb"
PLACEHOLDER = "PLACEHOLDER"


def normalized(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, ANY_SPACE, " "))


def words(text: Column) -> Column:
    flat = normalized(F.coalesce(text, F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def excerpt(text: Column, n: int = EXCERPT_WORDS) -> Column:
    """The n words around the middle, or the text unchanged if it has no more."""
    w = words(text)
    start = F.greatest(F.floor(F.size(w) / 2).cast("int") - n // 2, F.lit(0))
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, start + 1, n), " "))


def replace_placeholders(text: Column) -> Column:
    return F.replace(text, F.lit("[...]"), F.lit(PLACEHOLDER))


def embedding_text(context: Column, passage: Column) -> Column:
    """What an example is embedded by: context texts and passage, by spaces."""
    return F.trim(F.concat_ws(" ", F.array_join(F.transform(F.coalesce(context, F.array().cast(CONTEXT_DDL)), lambda c: c["text"]), " "), passage))


def query_text(context: Column, passage: Column) -> Column:
    """What a passage is searched by: context texts by "; ", then the passage."""
    joined = F.array_join(F.transform(context, lambda c: c["text"]), "; ")
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, F.concat(joined, F.lit(" "), passage)).otherwise(passage)


CONTEXT_DDL = "array<struct<text:string,type:string>>"


def fill_template(template: Column, labels: Column, background: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{{RAG_LABELS}}"), labels), F.lit("{{RAG_BACKGROUND}}"), background)


def validated_url(url: Column, host: str = "play.google.com") -> Column:
    """A URL with scheme and host, or null: a path gets the placeholder host, a missing scheme https."""
    u = F.trim(url)
    full = F.when(u.startswith("/"), F.concat(F.lit(f"https://{host}"), u)).when(~u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit("https://"), u)).otherwise(u)
    return F.when((u == "") | u.isNull(), None).when(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1) != "", full)


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def forwarding_notice(html: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.lit(False)
    for phrase in FORWARDING:
        said = said | F.contains(low, F.lit(phrase))
    return said | F.coalesce(html, F.lit("")).rlike(rf'<div[^>]*class="[^"]*\b{FORWARDING_CLASS}\b')


def is_pdf(url: Column, html: Column) -> Column:
    return F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False)) | F.contains(F.coalesce(html, F.lit("")), F.lit("application/pdf"))


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def custom_id(run: Column, task: Column, pkg: Column, idx: Column) -> Column:
    return F.concat_ws("_", run, task, pkg, idx.cast("string"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def spans_anchor(value: Column, passage: Column) -> Column:
    """Whether an annotation's value occurs in its passage, PLACEHOLDER standing for anything."""
    parts = F.transform(F.split(value, PLACEHOLDER), lambda p: F.concat(F.lit(r"\Q"), F.replace(F.trim(p), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.rlike(passage, F.concat(F.lit("(?s)"), F.array_join(parts, ".*")))


def backoff_seconds(attempt: int, uniform: float, limited: bool = False) -> float:
    """How long a client waits before it asks again; uniform lies in 0.5 .. 1.5."""
    return min(2.0 ** (attempt + 2), 60.0) if limited else min(2.0**attempt * uniform, 30.0)

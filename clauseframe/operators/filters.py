"""Document filters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseframe.functions import language
from clauseframe.functions import text as X

LANGUAGES = ("en",)


def by_length(df: DataFrame, text: str = "text", least: int = 0, most: int | None = None) -> DataFrame:
    """Rows whose text has so many words."""
    n = F.size(X.words(F.col(text)))
    return df.where((n >= least) if most is None else n.between(least, most))


def with_language(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``lang_found``, ``lang_prob`` and ``lang_bucket``."""
    got = df.withColumn("__l", language.language(F.col(text)))
    found, prob = F.col("__l.lang"), F.col("__l.prob")
    return got.withColumns({"lang_found": found, "lang_prob": prob, "lang_bucket": language.bucket(found, prob)}).drop("__l")


def by_language(df: DataFrame, text: str = "text", accepted: tuple[str, ...] = LANGUAGES, sure: float = language.SURE) -> DataFrame:
    got = with_language(df, text)
    return got.where(F.col("lang_found").isin(*accepted) & (F.col("lang_prob") >= sure)).select(df.columns)


def by_domain(df: DataFrame, url: str = "url", allowed: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """Rows whose host is, or is under, an allowed domain and no denied one."""
    host = F.lower(X.url_host(F.col(url)))

    def under(domains: list[str]) -> Column:
        return F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))

    kept = df.where(under(allowed)) if allowed is not None else df
    return kept.where(~under(denied)) if denied else kept


def first_of_equal(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, first_id, kept: of rows with equal texts the smallest key stays.

    Texts meet by their SHA-256, which stands for equality here, so none is shuffled. The smallest key of a text is summed
    up in parts before it moves, and a very frequent text's rows are split by the join, so no task has to hold them all.
    """
    rows = df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("__d"))
    first = rows.groupBy("__d").agg(F.min(key).alias("first_id"))
    return rows.join(first, "__d").select(key, "first_id", (F.col(key) == F.col("first_id")).alias("kept"))


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order: each partition passes on n at most."""
    return df.orderBy(*order).limit(n)


def unseen_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """One row for each URL, so that it is fetched once."""
    return df.dropDuplicates([url])


def routed(df: DataFrame, backend_verdict: Column) -> DataFrame:
    return df.withColumn("verdict", backend_verdict)


def type_counts(examples: DataFrame, kind: str = "type") -> DataFrame:
    return examples.groupBy(F.coalesce(F.col(kind), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")).orderBy("type")


def array_means(examples: DataFrame, *arrays: str) -> DataFrame:
    """The mean size of each array column over the rows that have it."""
    return examples.agg(*(F.avg(F.when(F.col(a).isNotNull(), F.size(a))).alias(f"mean_{a}") for a in arrays))


def confidence_by_requirement(static: DataFrame) -> DataFrame:
    return static.groupBy("requirement").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def progress(done: Column, total: Column) -> Column:
    return done / F.greatest(F.lit(1), total)


def state_changes(states: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows at which a key's state differs from the one before; the first counts."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col(state))).drop("__before")


def context_stack(blocks: DataFrame, doc: str, ord_col: str, tag: str, text: str) -> DataFrame:
    """doc, ord, context: the headline stack each block sees, natively, for documents of moderate length.

    A block sees the stack before it; a headline then cuts the stack at an entry of its own tag and goes on top.
    """
    entry = F.struct(F.col(ord_col).alias("ord"), F.col(tag).alias("tag"), F.col(text).alias("text"))
    rows = blocks.groupBy(doc).agg(F.sort_array(F.collect_list(entry)).alias("blocks"))
    stack_t = "array<struct<text:string,type:string>>"
    start = F.struct(F.array().cast(stack_t).alias("ctx"), F.array().cast(f"array<struct<ord:bigint,context:{stack_t}>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc["ctx"], lambda c: c["type"]), b["tag"]).cast("int")
        cut = F.when(at > 0, F.slice(acc["ctx"], F.lit(1), at - 1)).otherwise(acc["ctx"])
        top = F.array(F.struct(b["text"].alias("text"), b["tag"].alias("type")))
        ctx = F.when(b["tag"].rlike("^h[1-6]$"), F.concat(cut, top)).otherwise(acc["ctx"])
        return F.struct(ctx.cast(stack_t).alias("ctx"), F.concat(acc["out"], F.array(F.struct(b["ord"].cast("bigint").alias("ord"), acc["ctx"].alias("context")))).alias("out"))

    return rows.select(doc, F.explode(F.aggregate("blocks", start, step)["out"]).alias("o")).select(doc, F.col("o.ord").alias("ord"), F.col("o.context").alias("context"))

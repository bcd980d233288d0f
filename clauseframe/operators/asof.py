"""As-of join: each row with the last row of another table before it, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of time that a key's rows are dealt to.
SPLITS = 64


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], name: str = "match", allow_equal: bool = True, splits: int = SPLITS) -> DataFrame:
    """The left table with ``name``: a struct of the columns ``carry`` of the right row with equal ``by`` and the latest ``on`` that isn't
    after the left row's (before it, without ``allow_equal``); null without one.

    Both sides become one table, dealt by key and range of time and sorted there, through which the last right row is
    carried; so rows are shuffled once, and a key that holds a third of them is sorted by as many tasks as there are
    ranges. What is carried over a range's edge comes from a table with a row for each key and range that has right rows.

    Defined cases: null keys match nothing, and neither does a null ``on``; of right rows with the same key and ``on`` the one with
    the largest ``carry`` counts; left rows that repeat are each kept; an empty side is no special case. ``on`` is a number or a time.
    """
    as_number = lambda df: F.unix_micros(F.col(on).cast("timestamp")) if df.schema[on].dataType.typeName().startswith("timestamp") else F.col(on)
    row = F.struct(*(F.col(c) for c in left.columns))
    none = F.lit(None)
    keys = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)))
    known = lambda df: df.where(F.greatest(*(F.col(c).isNull().cast("int") for c in [*by, on]), F.lit(0)) == 0)
    kind = right.select(F.struct(*carry).alias("x")).schema["x"].dataType
    # Of rows at one time, right rows come first if they may match, else last.
    r = known(right).select(keys.alias("__k"), as_number(right).alias("__t"), F.lit(0 if allow_equal else 2).alias("__side"), F.struct(*carry).alias("__r"), none.cast(left.select(row.alias("x")).schema["x"].dataType).alias("__l"))
    l = left.select(keys.alias("__k"), as_number(left).alias("__t"), F.lit(1).alias("__side"), none.cast(kind).alias("__r"), row.alias("__l"))  # noqa: E741
    whole = right.select(as_number(right).alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    if whole["low"] is None:
        return left.withColumn(name, none.cast(kind))
    step = max((whole["high"] - whole["low"]) / splits, 1e-9)
    at = F.least(F.greatest(F.floor((F.col("__t") - F.lit(whole["low"])) / F.lit(step)), F.lit(-1)), F.lit(splits)).cast("int")
    both = l.unionByName(r).withColumn("__range", F.coalesce(at, F.lit(-1)))
    order = Window.partitionBy("__k", "__range").orderBy(F.asc_nulls_first("__t"), "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__m", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    last = r.withColumn("__range", at).groupBy("__k", "__range").agg(F.max(F.struct("__t", "__r"))["__r"].alias("__e"))
    spread = Window.partitionBy("__k").orderBy("__range")  # a row for each range of a key
    last = last.withColumn("__until", F.greatest(F.coalesce(F.lead("__range").over(spread), F.lit(splits)), F.col("__range") + 1))
    edges = last.select(F.col("__k").alias("__ek"), "__e", F.explode(F.sequence(F.col("__range") + 1, F.col("__until"))).alias("__er"))
    met = seen.join(edges, (F.col("__k") == F.col("__ek")) & (F.col("__range") == F.col("__er")), "left")
    return met.select(F.col("__l.*"), F.when(F.col("__t").isNotNull(), F.coalesce("__m", "__e")).alias(name))

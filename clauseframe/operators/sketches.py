"""Reports from sketches: distinct counts and quantiles stored for each stage and day, merged later without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 to this power registers for distinct counts, and the size of the quantile sketches.
REGISTER_BITS = 12
QUANTILE_K = 400
#: Estimates are held to be within so many standard errors of distinct counts, and so many times the 99 % rank error.
DEVIATIONS = 4.0
RANK_MARGIN = 2.0


def distinct_error(bits: int = REGISTER_BITS) -> float:
    """The relative standard error of a merged distinct count."""
    return 1.04 / 2 ** (bits / 2)


def rank_error(k: int = QUANTILE_K) -> float:
    """How far a quantile's rank is off at most, in 99 of 100 cases; the sketches' published fit, two fixed values."""
    return 2.296 / k**0.9723


def day_sketches(rows: DataFrame, stage: str, time: str, by: str, distinct: str, value: str, bits: int = REGISTER_BITS, k: int = QUANTILE_K) -> DataFrame:
    """(stage, day, ``by``, n, distinct_sketch, value_sketch), one row of bounded size for each day and key.

    Nulls count as rows, not as values; a sketch of nothing but nulls is empty. Tasks sketch before anything is shuffled,
    so a hot day or key costs no more than others.
    """
    found = rows.groupBy(F.lit(stage).alias("stage"), F.to_date(F.col(time)).alias("day"), F.col(by))
    return found.agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(bits)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("value_sketch"))


def merged(sketches: DataFrame, by: str) -> DataFrame:
    """Sketches of any days and stages as one for each key."""
    return sketches.groupBy(by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def report(sketches: DataFrame, by: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(``by``, n, n_distinct, quantiles): estimates of merged sketches; no values: no quantiles."""
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(q))) for q in quantiles]
    return merged(sketches, by).select(by, "n", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), F.array(*at).alias("quantiles"))


def _near(estimate: Column, exact: Column, bits: int) -> Column:
    return F.abs(estimate - exact) <= DEVIATIONS * distinct_error(bits) * exact


def against_rows(found: DataFrame, rows: DataFrame, by: str, distinct: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99), bits: int = REGISTER_BITS, k: int = QUANTILE_K) -> DataFrame:
    """(``by``, n, n_distinct, distinct_fits, quantiles_fit): a report beside exact values, and whether it keeps its stated bounds.

    A quantile fits if the rows below it and those up to it enclose its share, give or take the rank error: one pass
    over the rows joined to the report, which has a row for each key.
    """
    told = found.select(F.col(by).alias("__by"), F.col("n_distinct").alias("__told"), F.col("quantiles").alias("__q"))
    met = rows.select(by, F.col(distinct).alias("__d"), F.col(value).cast("double").alias("__v")).join(told, F.col(by).eqNullSafe(F.col("__by")))
    ranks = [F.avg((F.col("__v") < F.col("__q")[i]).cast("int")).alias(f"__b{i}") for i in range(len(quantiles))]
    ranks += [F.avg((F.col("__v") <= F.col("__q")[i]).cast("int")).alias(f"__t{i}") for i in range(len(quantiles))]
    exact = met.groupBy(by, "__told").agg(F.count("*").alias("n"), F.count_distinct("__d").alias("n_distinct"), *ranks)
    off = RANK_MARGIN * rank_error(k)
    fits = F.lit(True)
    for i, q in enumerate(quantiles):
        fits = fits & F.coalesce((F.col(f"__b{i}") <= q + off) & (F.col(f"__t{i}") >= q - off), F.lit(True))
    return exact.select(by, "n", "n_distinct", _near(F.col("__told"), F.col("n_distinct"), bits).alias("distinct_fits"), fits.alias("quantiles_fit"))

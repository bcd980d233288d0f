"""Mixing sources to target weights, with DataFrame and SQL functions on the whole data path.

Every source's words form one stream in pseudorandom document order, cut into blocks of a fixed number of words. The
mix is a sequence of slots of one block each, dealt to output shards: each shard draws its counts by source from a
multinomial over what the sources still owe, and the last shard takes what is left, so every source gives exactly
its target. The q-th slot of a source takes the block at q of a pseudorandom permutation of its block numbers, and
takes a new permutation each time it has gone through all blocks; slots and blocks then meet by an equi-join on
(source, block). So every word of a source is taken either k or k + 1 times, with k = target // size.

Sources stay in Spark, however many: their order, targets and slots are worked out there. The driver draws for bundles
of sources, one source each up to MOST_BUNDLES sources; of a larger bundle the slots are dealt to its counts by a
pseudorandom permutation, which is the same law.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.llm.common import SPACE, WORD, drop_table, materialize, word_count

BLOCK_WORDS = 512
OUTPUT_SHARDS = 64
#: A source gives at most so many times its words.
MOST_TIMES = 3
ROUNDS = 24
#: Documents of a bucket, about: what one task orders. Buckets whose sums are added up at once. Slots that one row of the plan stands for.
BUCKET_ROWS, GROUP_BUCKETS, RUN_SLOTS = 4_000, 4096, 4096
#: Bundles of sources that the driver draws for, at most.
MOST_BUNDLES = 1 << 16


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots by shard and bundle: multinomial draws over what is still owed; columns add up to ``slots``."""
    rng = np.random.default_rng(seed)
    owed = np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        room = int(owed.sum()) // (shards - k)
        if k == shards - 1:
            out[k] = owed
        elif room:
            drawn = np.minimum(rng.multinomial(room, owed / owed.sum()), owed)
            out[k] = drawn
        owed = owed - out[k]
    return out


def permuted(x: Column, n: Column, key: Column, back: bool = False) -> Column:
    """A keyed pseudorandom permutation of 0 .. n - 1 for any n: swap-or-not rounds, each exchanging x and k - x or not.

    ``back``: the other way; as each round undoes itself, that is the rounds in reverse.
    """
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(rounds, x, swap)


def plan_sources(sizes: DataFrame, weights: dict | None, block_words: int) -> DataFrame:
    """sizes: (__source, n). One row a source: __source, number, size, target, words (to take), slots (that take them), blocks.

    Sources are numbered by code point, null last; without weights they weigh 1, 2, 3, repeating. Targets are shares of
    all words by weight, none above MOST_TIMES its source's size, the excess shared anew by weight: a level per unit of
    weight rises until what is above its source's limit no longer changes.
    """
    spark = sizes.sparkSession
    order = [F.col("__source").isNull(), F.col("__source")]
    placed = sizes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.select("__source", "n", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i")), "mixing-order")
    counts = sorted((r["__p"], r["count"]) for r in placed.groupBy("__p").count().collect())  # one row a partition
    firsts = spark.createDataFrame([(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)], "__p int, __first long")
    numbered = placed.join(F.broadcast(firsts), "__p").select("__source", "n", (F.col("__first") + F.col("__i")).alias("number"))
    if weights is None:
        weight = (F.col("number") % 3 + 1).cast("double")
    else:  # given by the caller, one for each source it names
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    cap = MOST_TIMES * F.col("n")
    weighed = numbered.withColumn("weight", weight)
    open_ = weighed.where("n > 0 AND weight > 0")
    total = weighed.agg(F.sum("n")).first()[0] or 0
    level = float("inf")
    rest = open_.agg(F.sum("weight")).first()[0]
    while rest:
        before, level = level, total / rest if level == float("inf") else level
        above = F.lit(level) * F.col("weight") > cap
        capped, rest = open_.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        level = (total - capped) / rest if rest else float("inf")
        if level == before:
            break
    share = F.least(F.lit(level) * F.col("weight"), cap.cast("double")) if level != float("inf") else cap.cast("double")
    target = F.when((F.col("n") > 0) & (F.col("weight") > 0), share).otherwise(0.0)
    blocks = F.ceil(F.col("n") / block_words).cast("long")
    words = F.least(F.round(target).cast("long"), cap)
    made = weighed.select("__source", "number", F.col("n").alias("size"), target.alias("target"), words.alias("words"), blocks.alias("blocks"))
    part = F.col("words") - F.floor(F.col("words") / F.col("size")) * F.col("size")
    # Of the last time through, slots enough even if the short block is among them; the last ones may take nothing.
    more = F.when(part > 0, F.least(F.col("blocks"), F.ceil(part / block_words) + 1)).otherwise(0)
    slots = F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size")) * F.col("blocks") + more).otherwise(0)
    plan = materialize(made.withColumn("slots", slots.cast("long")), "mixing-plan")
    drop_table(placed)
    return plan


@dataclass
class Mix:
    #: All rows: __key, __row (the columns that ride along), __source, __size.
    rows: DataFrame
    #: Rows with words: __key, __source, __size, and __offset, where they start in their source's stream.
    stream: DataFrame
    #: (shard, slot, __source, __times, __block, __from, __to): which words of the source's stream a slot takes.
    slots: DataFrame
    #: One row a source, from ``plan_sources``.
    sources: DataFrame
    block_words: int


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    carry: list[str] | None = None, weights: dict | None = None, seed: int = 1, block_words: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS,
) -> Mix:
    """Plan a mix of all rows of a table.

    Defined cases: a null text has no words and is never taken; a null source is a source of its own, the last one;
    sources without words get nothing; repeated rows are documents of their own, equal ones interchangeable; null
    identifiers are ordered like empty ones; an empty table gives an empty mix; the columns of ``carry`` (default: all)
    ride along as they are, whatever their names. Rows are numbered once, in a table in the shared folder.
    """
    spark = df.sparkSession
    text, one = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    sized = materialize(
        df.select(
            F.monotonically_increasing_id().alias("__key"), F.struct(*(F.col(f"`{c}`") for c in (carry or df.columns))).alias("__row"),
            F.col(f"`{source_col}`").alias("__source"), word_count(text).alias("__size"),
            F.xxhash64(F.lit(seed), one, text).alias("__h"), F.coalesce(one.cast("string"), F.lit("")).alias("__id"),
        ),
        "mixing",
    )
    sizes = materialize(sized.groupBy("__source").agg(F.sum("__size").alias("n"), F.count("*").alias("rows")), "mixing-sizes")
    sources = plan_sources(sizes.select("__source", "n"), weights, block_words)
    buckets = max(1, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // BUCKET_ROWS))

    # Offsets: sums by (source, group of buckets), then by bucket inside a group, then inside each bucket, so that no source meets in one task.
    keyed = sized.where("__size > 0").select("__key", "__source", "__size", "__h", "__id", F.pmod(F.xxhash64("__h", "__id"), F.lit(buckets)).cast("int").alias("__bucket"))
    sums = keyed.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum")).withColumn("__group", F.floor(F.col("__bucket") / GROUP_BUCKETS))
    so_far = lambda by, order: F.sum("__sum").over(Window.partitionBy(*by).orderBy(order)) - F.col("__sum")
    groups = sums.groupBy("__source", "__group").agg(F.sum("__sum").alias("__sum"))
    groups = groups.select(F.col("__source").alias("__gs"), F.col("__group").alias("__g"), so_far(["__source"], "__group").alias("__groups"))
    before = sums.withColumn("__in_group", so_far(["__source", "__group"], "__bucket")).join(groups, F.col("__source").eqNullSafe(F.col("__gs")) & (F.col("__group") == F.col("__g")))
    before = before.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), (F.col("__groups") + F.col("__in_group")).alias("__base"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__h", "__id", "__key").rowsBetween(Window.unboundedPreceding, 0)
    stream = (
        keyed.withColumn("__in", F.sum("__size").over(inside) - F.col("__size"))
        .join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .select("__key", "__source", "__size", (F.col("__base") + F.col("__in")).alias("__offset"))
    )
    return Mix(sized, stream, _slots(spark, sources, shards, seed, block_words), sources, block_words)


def _slots(spark: SparkSession, sources: DataFrame, shards: int, seed: int, length: int) -> DataFrame:
    """All slots with the words they take."""
    per = max(1, -(-sources.count() // MOST_BUNDLES))
    used = sources.where("slots > 0").withColumn("bundle", F.floor(F.col("number") / per))
    owed = sorted((r["bundle"], r["n"]) for r in used.groupBy("bundle").agg(F.sum("slots").alias("n")).collect())  # MOST_BUNDLES rows at most
    counts = draw_counts([n for _, n in owed], shards, seed)
    at = np.cumsum(counts, axis=1) - counts  # slots of a shard before a bundle's
    text = lambda x: " ".join(map(str, x.tolist()))
    rows = [(b, n, text(np.cumsum(counts[:, i])), text(at[:, i] - np.cumsum(counts[:, i]) + counts[:, i])) for i, (b, n) in enumerate(owed)]
    drawn = spark.createDataFrame(rows, "bundle long, of long, ends string, shifts string")
    longs = lambda c: F.split(c, " ").cast("array<bigint>").alias(c)
    met = used.join(drawn.select("bundle", "of", longs("ends"), longs("shifts")), "bundle")
    base = F.sum("slots").over(Window.partitionBy("bundle").orderBy("number")) - F.col("slots") if per > 1 else F.lit(0).cast("long")
    met = met.withColumn("base", base)

    key = lambda t: F.xxhash64(F.lit(seed), "number", t)
    whole = F.floor(F.col("words") / F.col("size"))
    # Where the short block comes in the last, partial time through: the place that its permutation gives the last block.
    met = met.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), key(whole), back=True))
    runs = met.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("slots") / RUN_SLOTS) - 1)))
    # A source's row makes all its runs, and any task may make a run's slots; a number of tasks is named, as the rows are few and what they make isn't.
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "number", "run")
    each = runs.withColumn("in_run", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(RUN_SLOTS), F.col("slots") - F.col("run") * RUN_SLOTS) - 1)))
    q = each.withColumn("q", F.col("run") * RUN_SLOTS + F.col("in_run")).withColumn("p", F.col("base") + F.col("q"))
    if per > 1:
        q = q.withColumn("p", permuted(F.col("p"), F.col("of"), F.xxhash64(F.lit(seed), F.lit("bundle"), "bundle")))
    q = q.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("p"))))
    q = q.withColumn("slot", F.col("p") + F.get("shifts", F.col("shard")))
    times = F.floor(F.col("q") / F.col("blocks"))
    q = q.withColumn("__times", times).withColumn("k", F.col("q") - F.col("__times") * F.col("blocks"))
    q = q.withColumn("__block", permuted(F.col("k"), F.col("blocks"), key(F.col("__times"))))
    # In the last, partial time through, the words taken before a slot: whole blocks, but for the short block if it came earlier.
    short = F.col("blocks") * length - F.col("size")
    taken = F.col("k") * length - F.when(F.col("short_at") < F.col("k"), short).otherwise(0)
    here = F.least(F.lit(length), F.col("size") - F.col("__block") * length)
    rest = F.when(F.col("__times") < whole, here).otherwise(F.least(here, F.greatest(F.lit(0), F.col("words") - whole * F.col("size") - taken)))
    start = F.col("__block") * length
    return q.select("shard", "slot", "__source", "__times", "__block", start.alias("__from"), (start + rest).alias("__to")).where("__to > __from")


def pieces(m: Mix) -> DataFrame:
    """Every piece of a document in a slot: __key, __size, shard, slot, __times, and its words __begin to __end of the document."""
    length = m.block_words
    spans = m.stream.withColumn(
        "__block", F.explode(F.sequence(F.floor(F.col("__offset") / length), F.floor((F.col("__offset") + F.col("__size") - 1) / length)))
    )
    slots = m.slots.withColumnsRenamed({"__source": "__s", "__block": "__b"}).hint("merge")  # they grow with the words: nothing to broadcast
    met = spans.join(slots, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    begin = F.greatest(F.col("__from"), F.col("__offset")) - F.col("__offset")
    end = F.least(F.col("__to"), F.col("__offset") + F.col("__size")) - F.col("__offset")
    met = met.withColumns({"__begin": begin, "__end": end}).where("__end > __begin")
    return met.select("__key", "__size", "shard", "slot", "__times", "__begin", "__end")


def taken_words(m: Mix) -> DataFrame:
    """Every row of the table with the words the mix takes of it, repeats counted: __row, __source, __size, taken."""
    taken = pieces(m).groupBy("__key").agg(F.sum(F.col("__end") - F.col("__begin")).alias("__taken"))
    return m.rows.join(taken, "__key", "left").select("__row", "__source", "__size", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(m: Mix, text_col: str = "text") -> DataFrame:
    """The mix as documents with the carried columns: one row for each time that something of a document is taken.

    A document taken whole keeps its text to the character; of one taken in part, the text is the words taken, each
    with the white space before it.
    """
    spans = pieces(m).groupBy("__key", "__times").agg(F.sort_array(F.collect_list(F.struct("__begin", "__end"))).alias("__spans"), F.sum(F.col("__end") - F.col("__begin")).alias("__words"))
    met = m.rows.join(spans, "__key")
    text = F.col("__row").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(SPACE[:-1] + "*" + WORD), F.lit(0))
    taken = lambda w: F.flatten(F.transform("__spans", lambda s: F.slice(w, (s["__begin"] + 1).cast("int"), (s["__end"] - s["__begin"]).cast("int"))))
    cut = F.array_join(F.get(F.transform(F.array(words), taken), F.lit(0)), "")  # the words of a text are found once
    made = F.when(F.col("__words") == F.col("__size"), text).otherwise(cut)
    names = m.rows.schema["__row"].dataType.fieldNames()
    return met.select(*(made.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in names))

"""Few-shot retrieval: the most similar annotated examples for each passage, and those that go with a label."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseframe.functions import text as X

#: Bytes of a block of vectors; words that are looked up singly.
BLOCK_BYTES, SHORT = 4 << 20, 2
DIMENSIONS = 256
#: What a prompt says where there is no background.
NO_REQUIREMENTS, NO_BACKGROUND = "(No requirements provided, no legal background available.)", "(No legal background available for these requirements.)"
#: Largest example table that is scored by Spark's own expressions, and keyword queries of a block.
MOST_RELATIONAL, MOST_QUERIES = 1000, 10_000
SIMILAR, PER_LABEL, LEAST_SCORE = 5, 2, 0.5
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Offline stand-in for a sentence model: hashed character trigrams, unit length. Any function of this shape will do."""
    import zlib

    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for i, x in enumerate(texts):
        padded = f"  {(x or '').lower()} "
        for j in range(len(padded) - 2):
            h = zlib.crc32(padded[j : j + 3].encode())
            out[i, h % dimensions] += 1 if h & 0x80000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def with_embedding(df: DataFrame, text: Column, embedder: Embedder = hashed_embedder, name: str = "embedding") -> DataFrame:
    """The table with a vector for each row; equal texts are embedded once for each batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts.fillna(""))
        vectors = embedder(list(distinct)) if len(distinct) else np.zeros((0, 1))
        return pd.Series([vectors[c] for c in codes])

    return df.withColumn(name, run(text))


def effective_threshold(confidence: float) -> float:
    return min(confidence, 0.5)


def top_k(
    queries: DataFrame, examples: DataFrame, k: int, query_id: str = "query_id", example_id: str = "example_id", vector: str = "embedding",
    threshold: float | None = None, by: list[str] | None = None, exclude_self: bool = False, digits: int = 12,
) -> DataFrame:
    """(query_id, example_id, score, rank, *by): the k best examples of each query by dot product, ties by example id.

    A query is compared with the examples whose vectors are as long as its own; null vectors match nothing. Both sides are
    packed where they lie into blocks of bounded bytes. Blocks of examples are dealt to shards, and each block of queries is
    repeated for every shard and joined by its number, so every pair of blocks meets once, in one matrix product, and
    neither side is worked out twice. Only the k best of each query leave a pair: rows grow with queries and blocks, not
    with pairs. Scores are rounded to ``digits`` decimals, so that equal vectors tie wherever they lie in a block. ``by``: columns
    of the examples to search separately. For a search that doesn't compare with everything, see ``vector_index``.
    """
    by = by or []
    shards = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = packed(queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v")), "q").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    e = packed(examples.select(F.col(example_id).alias("id"), F.col(vector).alias("v"), *by), "e").withColumn("shard", F.pmod(F.xxhash64("e_matrix"), F.lit(shards)).cast("int"))
    scored = scored_blocks(q.join(e, "shard").where("q_width = e_width"), k, queries.schema[query_id].dataType, e, by, threshold, exclude_self, digits)
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.asc("example_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored_blocks(met: DataFrame, k: int, query_kind: T.DataType, examples: DataFrame, by: list[str], threshold: float | None, exclude_self: bool, digits: int = 12) -> DataFrame:
    """(query_id, example_id, score, *by): of every pair of blocks the k best of each query."""
    kept = met.select("q_width", "q_ids", "q_matrix", "e_ids", "e_matrix", *(f"e_{c}" for c in by))
    kinds = [query_kind, examples.schema["e_ids"].dataType.elementType, T.DoubleType(), *(examples.schema[f"e_{c}"].dataType.elementType for c in by)]
    out = T.StructType([T.StructField(n, t) for n, t in zip(["query_id", "example_id", "score", *by], kinds, strict=True)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                width, q_ids, q_bytes, e_ids, e_bytes, *keys = (c[i].as_py() for c in b.columns)
                scores = np.frombuffer(q_bytes).reshape(-1, width) @ np.frombuffer(e_bytes).reshape(-1, width).T
                rows = _best(np.round(scores, digits), q_ids, e_ids, keys, k, threshold, exclude_self)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(arrow)], schema=arrow)

    return kept.mapInArrow(run, out)


def packed(rows: DataFrame, side: str, keys: list[str] | None = None) -> DataFrame:
    """Rows (id, v, further columns) as blocks of vectors of one length, by id: ``<side>_width``, ``_ids``, ``_matrix`` and a list of
    each further column. With ``keys``, by which the rows of a partition must be sorted, a block has one value of each, in its own column.
    """
    keys = keys or []
    rest = [c for c in rows.columns if c not in ("id", "v", *keys)]
    out = T.StructType(
        [*(rows.schema[c] for c in keys), T.StructField(f"{side}_width", T.IntegerType()), T.StructField(f"{side}_ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField(f"{side}_matrix", T.BinaryType())]
        + [T.StructField(f"{side}_{c}", T.ArrayType(rows.schema[c].dataType)) for c in rest]
    )
    arrow = to_arrow_schema(out)
    n = len(keys)

    def block(key: tuple, width: int, held: list[tuple]) -> pa.RecordBatch:
        held = sorted(held, key=lambda r: (r[0] is None, r[0]))
        columns = list(zip(*held, strict=True))
        made = [*([x] for x in key), [width], [list(columns[0])], [np.stack(columns[1]).tobytes()], *([list(c)] for c in columns[2:])]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        at: tuple = ()
        for b in batches:
            for one, v, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if v and tuple(more[:n]) != at:
                    for width, same in held.items():
                        yield block(at, width, same)
                    held, at = {}, tuple(more[:n])
                if v:
                    same = held.setdefault(len(v), [])
                    same.append((one, np.asarray(v, dtype=np.float64), *more[n:]))
                    if len(same) >= max(1, BLOCK_BYTES // (8 * len(v))):
                        yield block(at, len(v), held.pop(len(v)))
        for width, same in held.items():
            yield block(at, width, same)

    return rows.select("id", "v", *keys, *rest).mapInArrow(run, out)


def _best(scores: np.ndarray, q_ids: list, e_ids: list, keys: list[list], k: int, threshold: float | None, exclude_self: bool) -> list[tuple]:
    """Of a block's scores (queries by examples) the k best of each query in each group; examples come by id."""
    groups: dict[tuple, list[int]] = {}
    for j in range(len(e_ids)):
        groups.setdefault(tuple(c[j] for c in keys), []).append(j)
    if exclude_self:
        place = {one: j for j, one in enumerate(e_ids)}
        for i, one in enumerate(q_ids):
            if one in place:
                scores[i, place[one]] = -np.inf
    least = -np.inf if threshold is None else threshold
    out = []
    for key, at in groups.items():
        s = scores[:, at] if len(groups) > 1 else scores
        edge = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        for i, one in enumerate(q_ids):
            near = np.flatnonzero((s[i] >= max(edge[i], least)) & (s[i] > -np.inf))
            out += [(one, e_ids[at[j]], float(s[i, j]), *key) for j in near[np.argsort(-s[i, near], kind="stable")[:k]]]
    return out


def merge_best(best: list[list[tuple]], scores: np.ndarray, e_ids: list, k: int) -> None:
    """Put into each query's k best so far, (score, example id) in order, what belongs there of a block's scores (queries by examples)."""
    least = np.array([b[-1][0] if len(b) == k else -np.inf for b in best])
    for i in np.flatnonzero(scores.max(axis=1) >= least):
        edge = max(least[i], np.partition(scores[i], -k)[-k] if scores.shape[1] > k else -np.inf)
        found = best[i] + [(float(scores[i, j]), e_ids[j]) for j in np.flatnonzero(scores[i] >= edge)]
        best[i] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]


def top_k_relational(queries: DataFrame, examples: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The same with Spark's own expressions, for example tables of at most a few hundred rows: scores, then a rank limit for each query."""
    if (n := examples.count()) > MOST_RELATIONAL:
        raise ValueError(f"{n} examples: use top_k")
    pairs = queries.crossJoin(F.broadcast(examples)).withColumn("score", X.dot(F.col("query_embedding"), F.col("embedding")))
    if threshold is not None:
        pairs = pairs.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("example_id"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "example_id", "score", "rank")


def payload(scheme: str, type_: Column, context: Column, passage: Column) -> Column:
    """What a few-shot example shows as the user's message."""
    return F.to_json(F.struct(type_.alias("type"), context.alias("context"), passage.alias("passage")) if scheme == "transparency" else F.struct(passage.alias("passage")))


def similar_fewshots(passages: DataFrame, examples: DataFrame, k: int = SIMILAR, least: float = LEAST_SCORE, scheme: str = "transparency", task: str = "annotate") -> DataFrame:
    """(query_id, fewshots): the k most similar examples above the threshold, best first, as user and assistant messages."""
    hits = top_k(passages, examples, k, threshold=least)
    answer = F.struct(F.col("labels").alias("labels")) if task == "classify" else F.struct(F.transform("annotations", _with_placeholders).alias("annotations"))
    met = hits.join(examples.select("example_id", "type", "context", "passage", "annotations", "labels"), "example_id")
    shot = F.struct("rank", payload(scheme, F.col("type"), F.col("context"), X.replace_placeholders(F.col("passage"))).alias("user"), F.to_json(answer).alias("assistant"))
    return met.groupBy("query_id").agg(F.sort_array(F.collect_list(shot)).alias("fewshots"))


def _with_placeholders(a: Column) -> Column:
    return F.struct(a["requirement"].alias("requirement"), X.replace_placeholders(a["value"]).alias("value"), a["performed"].alias("performed"))


def label_fewshots(passages: DataFrame, examples: DataFrame, n: int = PER_LABEL, least: float = LEAST_SCORE, scheme: str = "transparency", strict_label: bool = False) -> DataFrame:
    """(query_id, label, ord, fewshots) for each label of a passage, ord being its place: of its 2n most similar examples one shot for each annotation, n at most.

    With a passage given, hits don't depend on the label, so they are searched once for each passage and repeated for its
    labels; a hit without annotations carries the label that was asked for. ``strict_label``: only annotations of that label.
    """
    hits = top_k(passages, examples, 2 * n)
    met = hits.join(examples.select("example_id", "type", "context", "passage", "annotations"), "example_id")
    each = met.select("query_id", "rank", "score", "type", "context", "passage", F.posexplode_outer("annotations").alias("pos", "a")).where(F.col("score") >= least)
    asked = passages.select("query_id", F.posexplode("labels").alias("ord", "label"))
    both = asked.join(each, "query_id").withColumn("a", F.coalesce("a", F.struct(F.col("label").alias("requirement"), F.lit("").alias("value"), F.lit(False).alias("performed"))))
    if strict_label:
        both = both.where(F.col("a.requirement") == F.col("label"))
    w = Window.partitionBy("query_id", "ord").orderBy(F.desc("score"), "rank", "pos")
    few = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    answer = F.to_json(F.struct(F.array(_with_placeholders(F.col("a"))).alias("annotations")))
    shot = F.struct(F.col("r").alias("rank"), payload(scheme, F.col("type"), F.col("context"), X.replace_placeholders(F.col("passage"))).alias("user"), answer.alias("assistant"))
    return few.groupBy("query_id", "label", "ord").agg(F.sort_array(F.collect_list(shot)).alias("fewshots"))


def combined_fewshots(similar: DataFrame, by_label: DataFrame) -> DataFrame:
    """(query_id, fewshots): similar ones first, then those of the labels in their order; repeats stay."""
    labelled = by_label.groupBy("query_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label", "fewshots"))), lambda x: x["fewshots"])).alias("more"))
    empty = F.array().cast("array<struct<rank:int,user:string,assistant:string>>")
    return similar.join(labelled, "query_id", "full").select("query_id", F.concat(F.coalesce("fewshots", empty), F.coalesce("more", empty)).alias("fewshots"))


def curated_examples(static: DataFrame, requirements: DataFrame, n: int, confidence: float) -> DataFrame:
    """Of the curated examples of each requirement with enough confidence, n: the surest if there are more than n, else all in order."""
    w, every = Window.partitionBy("requirement"), F.count("*").over(Window.partitionBy("requirement"))
    met = static.where(F.col("confidence") >= confidence).join(requirements.select("requirement").distinct(), "requirement").withColumn("of", every)
    rank = F.row_number().over(w.orderBy(F.when(F.col("of") > n, -F.col("confidence")).otherwise(F.lit(0.0)), "ord"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).drop("of")


def curated_fewshots(passages: DataFrame, static: DataFrame, n: int, confidence: float) -> DataFrame:
    """(query_id, fewshots) from curated examples: n of each label of a passage (query_id, labels), labels in their order."""
    asked = passages.select("query_id", F.posexplode("labels").alias("ord_label", "requirement"))
    few = curated_examples(static, static.select("requirement"), n, confidence)
    answer = F.to_json(F.struct(F.array(F.struct("requirement", F.col("annotation_value").alias("value"), "performed")).alias("annotations")))
    shot = F.struct("ord_label", "rank", F.to_json(F.struct("passage")).alias("user"), answer.alias("assistant"))
    met = asked.join(F.broadcast(few), "requirement").groupBy("query_id").agg(F.sort_array(F.collect_list(shot)).alias("s"))  # a few dozen curated rows
    return met.select("query_id", F.transform("s", lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("fewshots"))


def examples_for_requirements(examples: DataFrame, requirements: DataFrame) -> DataFrame:
    """(requirement, label) and the example's columns: each requirement with the examples that have a label containing it, upper case
    as lower. The distinct labels meet the requirements, not the examples: both are vocabularies of a few dozen names.
    """
    each = examples.withColumn("label", F.explode("labels"))
    asked = requirements.select("requirement").distinct()
    names = each.select("label").distinct()
    met = names.join(asked, F.contains(F.lower(names["label"]), F.lower(asked["requirement"])))
    return each.join(met, "label").select("requirement", "label", *examples.columns)


def background(rows: DataFrame, knowledge: DataFrame, text: Column, labels: str = "labels", name: str = "background") -> DataFrame:
    """The table with one text of what the knowledge base says of each row's labels, in their order.

    knowledge: one row a label (``label``), a few dozen rows; ``text``: its text for a prompt, null if there is none, from
    ``vocab.background_text`` or ``vocab.category_text``. A row without labels, or with none that the base knows, says so.
    """
    known = knowledge.groupBy("label").agg(F.min(text).alias("__text")).where("__text IS NOT NULL")
    by_label = known.agg(F.map_from_entries(F.collect_list(F.struct("label", "__text"))).alias("__known"))
    found = F.filter(F.transform(F.col(labels), lambda x: F.col("__known")[x]), lambda x: x.isNotNull())
    none = F.when(F.coalesce(F.size(labels), F.lit(0)) == 0, F.lit(NO_REQUIREMENTS)).when(F.size(found) == 0, F.lit(NO_BACKGROUND))
    return rows.crossJoin(F.broadcast(by_label)).withColumn(name, F.coalesce(none, F.array_join(found, "\n\n"))).drop("__known")


def examples_by_label(examples: DataFrame, requirement: str) -> DataFrame:
    """Examples with a label that contains the requirement, upper case as lower."""
    return examples.where(F.exists("labels", lambda x: F.contains(F.lower(x), F.lit(requirement.lower()))))


def keyword_top_k(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", block_queries: int = MOST_QUERIES) -> DataFrame:
    """(query_id, doc_id, score, rank): by how many of a query's distinct words, of any case, a text contains. All texts are searched for
    all queries.

    Queries stay in Spark: they are packed into blocks of bounded rows and bytes, and every block of them meets every block
    of texts by a join on the text block's shard, as in ``top_k``. A task builds one automaton for a block of queries, and
    passes on the k best of each query of each pair of blocks. Where the queries are one small block, Spark sends it to the texts.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_text_batches(docs.sparkSession)
    asked = _query_blocks(queries.select("query_id", F.lower(F.col("query")).alias("query")), block_queries)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    blocks = _text_blocks(low).withColumn("shard", F.pmod(F.xxhash64("doc_ids"), F.lit(shards)).cast("int"))
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.IntegerType())])
    met = blocks.join(asked, "shard").select("block", "query_ids", "queries", "doc_ids", "bodies").mapInArrow(_count_words(k, out), out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def small_text_batches(spark, most: int = 2 << 20) -> None:
    """Hand texts to Python workers in batches of bounded bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(key, str(most))


def _query_blocks(queries: DataFrame, most: int) -> DataFrame:
    """(block, query_ids, queries): as the rows lie, so many or BLOCK_BYTES of them."""
    out = T.StructType([T.StructField("block", T.StringType()), T.StructField("query_ids", T.ArrayType(queries.schema["query_id"].dataType)), T.StructField("queries", T.ArrayType(T.StringType()))])
    return queries.mapInArrow(_in_blocks(lambda q: len(q or ""), most, to_arrow_schema(out), named=True), out)


def _text_blocks(texts: DataFrame) -> DataFrame:
    """(doc_ids, bodies): as the rows lie, BLOCK_BYTES of them."""
    out = T.StructType([T.StructField("doc_ids", T.ArrayType(texts.schema["doc_id"].dataType)), T.StructField("bodies", T.ArrayType(T.StringType()))])
    return texts.mapInArrow(_in_blocks(len, MOST_QUERIES, to_arrow_schema(out)), out)


def _in_blocks(size: Callable[[str], int], most: int, arrow: pa.Schema, named: bool = False):
    def block(held: list[tuple]) -> pa.RecordBatch:
        columns = [[list(c)] for c in zip(*held, strict=True)]
        name = [[hashlib.sha256(repr(held).encode()).hexdigest()]] if named else []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*name, *columns], arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                room += size(row[1])
                if len(held) >= most or room >= BLOCK_BYTES:
                    yield block(held)
                    held, room = [], 0
        if held:
            yield block(held)

    return run


def _finder(words: list[str]) -> Callable[[str], list[int]]:
    """Which of some words a text holds: one pass over the text by an automaton, single look-ups for very short words."""
    short = [(w, i) for i, w in enumerate(words) if len(w) <= SHORT]
    long = [(w, i) for i, w in enumerate(words) if len(w) > SHORT]
    try:
        import ahocorasick
    except ImportError:
        return lambda body: [i for i, w in enumerate(words) if w in body]
    tree = ahocorasick.Automaton()
    for w, i in long:
        tree.add_word(w, i)
    if long:
        tree.make_automaton()
    return lambda body: [i for w, i in short if w in body] + (list({i for _, i in tree.iter(body)}) if long else [])


def _count_words(k: int, out: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    arrow = to_arrow_schema(out)

    def made(queries: list[str | None]) -> tuple[Callable[[str], list[int]], list[np.ndarray]]:
        """What finds a block's words in a text, and the queries of each word: linear in their words, where a matrix would grow as a product."""
        holders: dict[str, list[int]] = {}
        for j, query in enumerate(queries):
            for w in dict.fromkeys((query or "").split()):
                holders.setdefault(w, []).append(j)
        return _finder(list(holders)), [np.array(js) for js in holders.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, find, held = None, None, []
        for b in batches:
            for block, names, queries, ids, bodies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != last:
                    last, (find, held) = block, made(queries)
                best: list[list[tuple]] = [[] for _ in names]  # heaps of (score, least favoured id first)
                for one, body in zip(ids, bodies, strict=True):
                    hit = find(body)
                    scores = np.bincount(np.concatenate([held[i] for i in hit])) if hit else ()
                    for j in np.flatnonzero(scores).tolist():
                        entry, heap = (int(scores[j]), _Last(one)), best[j]
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
                rows = [(names[j], entry.one, score) for j, heap in enumerate(best) for score, entry in heap]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(arrow)], schema=arrow)

    return run


class _Last:
    """Orders identifiers backwards, null first, as it is favoured when ascending."""

    __slots__ = ("one",)

    def __init__(self, one):
        self.one = one

    def __eq__(self, other) -> bool:
        return self.one == other.one

    def __lt__(self, other) -> bool:
        return self.one is not None and (other.one is None or other.one < self.one)


def index_stats(examples: DataFrame, kind: str = "example_type") -> DataFrame:
    return examples.groupBy(kind).agg(F.count("*").alias("n_examples"), F.max(F.size("embedding")).alias("dimension"))

"""Aggregates over vectors, and what is fitted with them: TF-IDF embeddings, a language model, centroids of labels.

Each is a sum of vectors by key. A task adds up the vectors of each key that it meets and passes on one row a key, so what
is shuffled grows with keys and tasks, not with rows, and a key that holds most rows is summed by all tasks. The
fitted tables have a fixed number of numbers for each key, whatever the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseframe.functions import ngrams
from clauseframe.operators.retrieve import BLOCK_BYTES, merge_best, packed, small_text_batches
from clauseframe.sources import sinks

#: Keys whose sums a task holds before it passes them on; queries of a part of them; bytes of a row group of blocks.
MOST_KEYS, MOST_QUERIES, GROUP_BYTES = 4096, 8192, 8 << 20


def vector_sums(rows: DataFrame, key: str, value: str, vector_of: Callable[[object], np.ndarray | None]) -> DataFrame:
    """(key, n, total): for each key the number and the sum of its rows' vectors, which ``vector_of`` makes of a value; rows for
    which it gives none don't count. All vectors of a key must be of one length.
    """
    kind = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([*held], [h[0] for h in held.values()], [h[1] for h in held.values()]), arrow, strict=True)], schema=arrow)

        for b in batches:
            for one, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = vector_of(v)
                if made is None:
                    continue
                if one in held:
                    held[one][0] += 1
                    held[one][1] += made
                else:
                    held[one] = [1, made.astype(np.float64)]
                    if len(held) > MOST_KEYS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    parts = rows.select(key, value).mapInArrow(run, kind)
    # A row a key and task: their elements are added where they meet.
    each = parts.select("key", "n", F.posexplode("total").alias("at", "x"))
    summed = each.groupBy("key", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return summed.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("total"))


# ---- TF-IDF ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TfIdf:
    """Weights by bucket of hashed character n-grams."""

    idf: np.ndarray

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "text", size: int = ngrams.BUCKETS) -> TfIdf:
        """In one pass over all texts: how many hold an n-gram of each bucket. Empty texts and null count as texts without any."""
        small_text_batches(texts.sparkSession)
        one = texts.select(F.lit(0).alias("one"), F.col(text).alias("text"))
        found = vector_sums(one, "one", "text", lambda x: (ngrams.counts(x, size) > 0).astype(np.float64)).first()
        n, df = (found["n"], np.array(found["total"])) if found else (0, np.zeros(size))
        return cls(np.log((1 + n) / (1 + df)) + 1)

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit length; none for a text without n-grams."""
        if not text:
            return None
        made = ngrams.counts(text, len(self.idf)) * self.idf
        return made / np.linalg.norm(made)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """As an embedder: zeros for a text without n-grams."""
        zero = np.zeros(len(self.idf))
        return np.array([zero if (v := self.vector(x)) is None else v for x in texts]).reshape(len(texts), len(self.idf))

    def embed(self, df: DataFrame, text: str = "text", name: str = "embedding", keep: list[str] | None = None) -> DataFrame:
        """The kept columns with each text's vector, null for a text without n-grams; a few megabytes of vectors at a time."""
        small_text_batches(df.sparkSession)
        keep = [c for c in (keep if keep is not None else df.columns) if c != name]
        out = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.DoubleType()))])
        step = max(1, BLOCK_BYTES // (8 * len(self.idf)))
        vector = self.vector

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    b = whole.slice(i, step)
                    made = [vector(x) for x in b.column(b.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=out.fieldNames())

        return df.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(run, out)

    def top_k(self, queries: DataFrame, docs: DataFrame, k: int, digits: int = 12) -> DataFrame:
        """queries (query_id, text) against docs (example_id, text): the k most alike by cosine, as ``retrieve.top_k`` gives them.

        Both sides are written to the shared folder once, as blocks of counts rather than of weighted vectors, and every file's
        part of one meets every part of the other: nothing is repeated in a shuffle. A task weighs the counts of a pair of blocks
        and keeps the k best of each query over all that it meets; only these leave it.
        """
        ids = [queries.schema["query_id"].dataType, docs.schema["example_id"].dataType]
        parts = -(-queries.count() // MOST_QUERIES) or 1
        q = self._blocks(queries.select(F.col("query_id").alias("id"), "text").repartition(parts), "q")
        e = self._blocks(docs.select(F.col("example_id").alias("id"), "text"), "e")
        out = T.StructType([T.StructField(n, t) for n, t in zip(["query_id", "example_id", "score"], [*ids, T.DoubleType()], strict=True)])
        arrow, idf = to_arrow_schema(out), self.idf

        def weighted(counts: bytes) -> np.ndarray:
            made = np.frombuffer(counts, dtype=np.uint32).reshape(-1, len(idf)) * idf
            return made / np.linalg.norm(made, axis=1, keepdims=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last, e_ids, right = {}, None, [], np.zeros((0, len(idf)))

            def kept() -> pa.RecordBatch:
                rows = [(one, x, score) for (ids, best) in held.values() for one, near in zip(ids, best, strict=True) for score, x in near]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 3, arrow, strict=True)], schema=arrow)

            for b in batches:
                for i in range(b.num_rows):
                    q_block, q_ids, q_counts, e_block, new_ids, e_counts = (c[i] for c in b.columns)
                    if e_block.as_py() != last:
                        last, e_ids, right = e_block.as_py(), new_ids.as_py(), weighted(e_counts.as_py())
                    if q_block.as_py() not in held:
                        names = q_ids.as_py()
                        if sum(len(ids) for ids, _ in held.values()) + len(names) > 2 * MOST_QUERIES:
                            yield kept()
                            held.clear()
                        held[q_block.as_py()] = names, [[] for _ in names]
                    merge_best(held[q_block.as_py()][1], np.round(weighted(q_counts.as_py()) @ right.T, digits), e_ids, k)
            if held:
                yield kept()

        scored = e.crossJoin(q).select("q_block", "q_ids", "q_counts", "e_block", "e_ids", "e_counts").mapInArrow(run, out)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("example_id"))
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def _blocks(self, texts: DataFrame, side: str) -> DataFrame:
        """Texts (id, text) that have n-grams as blocks of their counts, by id, written and read again: ``<side>_block``, a name, ``_ids``
        and ``_counts``. Parquet would else look at a row group's bytes only every hundred rows, and rows are large here."""
        small_text_batches(texts.sparkSession)
        size, step = len(self.idf), max(1, BLOCK_BYTES // (8 * len(self.idf)))
        out = T.StructType([T.StructField(f"{side}_block", T.StringType()), T.StructField(f"{side}_ids", T.ArrayType(texts.schema["id"].dataType)), T.StructField(f"{side}_counts", T.BinaryType())])
        arrow = to_arrow_schema(out)

        def block(held: list[tuple]) -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0]))
            made = [uuid.uuid4().hex], [[r[0] for r in held]], [np.stack([r[1] for r in held]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for b in batches:
                for one, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if x:
                        held.append((one, ngrams.counts(x, size).astype(np.uint32)))
                    if len(held) == step:
                        yield block(held)
                        held = []
            if held:
                yield block(held)

        path = f"{sinks.scratch_folder(texts.sparkSession)}/counts-{uuid.uuid4().hex}"
        row_groups = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
        texts.select("id", "text").mapInArrow(run, out).write.options(**row_groups).parquet(path)
        return texts.sparkSession.read.schema(out).parquet(path)


# ---- languages ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LanguageModel:
    """Multinomial naive Bayes over hashed character n-grams: languages in order, log priors, and log likelihoods by bucket."""

    languages: list[str]
    priors: np.ndarray
    likelihoods: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, text: str = "text", lang: str = "lang", size: int = ngrams.BUCKETS, most_languages: int = 1000) -> LanguageModel:
        """Counts by language, with one added to each bucket; rows without a language or text don't count. Languages are a vocabulary: beyond
        ``most_languages`` they aren't, and fitting refuses."""
        small_text_batches(rows.sparkSession)
        known = rows.where(F.col(lang).isNotNull() & (F.length(text) > 0))
        found = vector_sums(known, lang, text, lambda x: ngrams.counts(x, size)).orderBy("key").limit(most_languages + 1).collect()
        if len(found) > most_languages:
            raise ValueError(f"more than {most_languages} languages")
        n = np.array([r["n"] for r in found], dtype=np.float64)
        totals = np.array([r["total"] for r in found]).reshape(len(found), size)
        return cls([r["key"] for r in found], np.log(n / n.sum()) if len(n) else n, np.log((totals + 1) / (totals.sum(axis=1, keepdims=True) + size)))

    def scores(self, text: str | None) -> np.ndarray | None:
        """Log of prior and likelihood of each language; none for a text without n-grams."""
        return self.priors + self.likelihoods @ ngrams.counts(text, self.likelihoods.shape[1]) if text and self.languages else None

    def identify(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The table with ``lang_found``, ``lang_prob`` and ``lang_odds`` (log odds of the best against the next one; of equal ones the first
        by name is best). A text without n-grams is ``unknown`` with probability 0 and no odds; with one language there are no odds either."""
        small_text_batches(df.sparkSession)
        keep = [c for c in df.columns if c not in ("lang_found", "lang_prob", "lang_odds")]
        out = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_found", T.StringType()), T.StructField("lang_prob", T.DoubleType()), T.StructField("lang_odds", T.DoubleType())])
        scores, names = self.scores, self.languages

        def judged(x: str | None) -> tuple[str, float, float | None]:
            s = scores(x)
            if s is None:
                return "unknown", 0.0, None
            best = int(np.argmax(s))
            rest = np.delete(s, best)
            return names[best], float(1 / np.exp(s - s[best]).sum()), float(s[best] - rest.max()) if len(rest) else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = list(zip(*map(judged, b.column(b.num_columns - 1).to_pylist()), strict=True)) or [(), (), ()]
                columns = [pa.array(c, t) for c, t in zip(made, (pa.string(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=out.fieldNames())

        return df.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(run, out)


# ---- labels ------------------------------------------------------------------------------------------------------


def label_centroids(examples: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n, embedding): the mean vector of each label's examples; null vectors don't count."""
    found = vector_sums(examples, label, vector, lambda v: None if v is None else np.asarray(v, dtype=np.float64))
    return found.select(F.col("key").alias(label), "n", F.transform("total", lambda x: x / F.col("n")).alias("embedding"))


def label_by_cosine(rows: DataFrame, centroids: DataFrame, row_id: str, label: str = "label", vector: str = "embedding", least: float = 0.3, digits: int = 12) -> DataFrame:
    """(row_id, label, cosine): the label whose centroid points most the same way, of equal ones the smallest; null below ``least``.

    The centroids are written once, and rows meet them where they lie: Spark sends so small a table to all tasks, or, if there are
    very many labels, lets parts of both meet. Of a block of rows only the best labels go on, so no vector is shuffled. A vector
    of zeros has no direction: its cosine is NaN, which counts as larger than any number.
    """
    spark = rows.sparkSession
    path = f"{sinks.scratch_folder(spark)}/centroids-{uuid.uuid4().hex}"
    packed(centroids.select(F.col(label).alias("id"), F.col("embedding").alias("v")), "e").write.parquet(path)
    q, e = packed(rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v")), "q"), spark.read.parquet(path)
    out = T.StructType([T.StructField("id", rows.schema[row_id].dataType), T.StructField("label", centroids.schema[label].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def unit(matrix: bytes, width: int) -> np.ndarray:
        made = np.frombuffer(matrix).reshape(-1, width)
        with np.errstate(invalid="ignore"):
            return made / np.sqrt((made * made).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, left, score, names = None, None, None, None
        for b in batches:
            for q_width, q_ids, q_matrix, e_width, e_ids, e_matrix in zip(*b.columns, strict=True):
                if q_width != e_width:
                    continue
                if ids is None or q_ids != ids:
                    if ids is not None:
                        yield pa.RecordBatch.from_arrays([ids.values, pa.array(names, arrow[1].type), pa.array(score)], schema=arrow)
                    ids, left = q_ids, unit(q_matrix.as_py(), q_width.as_py())
                    score, names = np.full(len(left), -np.inf), [None] * len(left)
                new = np.round(left @ unit(e_matrix.as_py(), e_width.as_py()).T, digits)
                at = np.where(np.isnan(new), np.inf, new).argmax(axis=1)
                new, found = new[np.arange(len(new)), at], e_ids.as_py()
                rank, before = (np.where(np.isnan(x), np.inf, x) for x in (new, score))
                for i in np.flatnonzero(rank >= before):
                    one = found[at[i]]
                    if rank[i] > before[i] or (one is None, one) < (names[i] is None, names[i]):
                        score[i], names[i] = new[i], one
        if ids is not None:
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(names, arrow[1].type), pa.array(score)], schema=arrow)

    best = q.crossJoin(e).select("q_width", "q_ids", "q_matrix", "e_width", "e_ids", "e_matrix").mapInArrow(run, out)
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc_nulls_last("label"))
    first = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1)
    return first.select(F.col("id").alias(row_id), F.when(F.col("score") >= least, F.col("label")).alias(label), F.col("score").alias("cosine"))

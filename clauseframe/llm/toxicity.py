"""Toxicity by classifier chains.

Categories are predicted one after the other; each later model also sees the probabilities that the earlier ones
give. In training these come from folds that the document wasn't in, so a later model learns how far the earlier ones
can be trusted on new texts. The models are linear (logistic, elastic net) over hashed features of a document's distinct
words: the word, its pieces of five characters, and the marks hung on it. Because features are taken by word, a word's
share in each score is worked out once and kept, and scoring is one look-up for each distinct word of a text.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, first_by_hash, map_texts, small_batches

#: Labelled documents that the models are fitted on, at most: half for each value of the last category.
TRAIN_ROWS = 5_000
#: Longest text that is trained on: it bounds what the fitting task holds. All texts are scored, whole.
TRAIN_CHARS = 50_000
#: Features that stay, at most: those whose presence tells most of any category; documents that must hold one.
FEATURES, LEAST_DOCS = 4_000, 3
FOLDS, ROUNDS = 3, 300
L1, L2 = 3e-4, 1e-4
THRESHOLD = 0.5
#: Characters of a word that features are taken of; a longer run without white space is cut into words of that length.
WORD_CHARS, PIECE = 64, 5
#: Words whose scores a task keeps.
CACHE_WORDS = 200_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CORE = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text; long ones in parts."""
    out = set()
    for w in set(_SPACE.split(text)):
        if len(w) <= WORD_CHARS:
            out.add(w)
        else:
            out.update(w[i : i + WORD_CHARS] for i in range(0, len(w), WORD_CHARS))
    out.discard("")
    return out


def features_of(word: str) -> list[int]:
    """Hashed features of a word."""
    found = []
    for core in _CORE.findall(word.lower()):
        found.append("w" + core)
        found += ["p" + core[i : i + PIECE] for i in range(len(core) - PIECE + 1)] if len(core) > PIECE else []
    marks = _CORE.sub("", word)
    if marks:
        found.append("m" + marks[:8])
    if word.isupper() and len(word) > 1:
        found.append("u")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) - (1 << 31) for f in found]


@dataclass
class Chain:
    categories: list[str]
    #: For each feature that has any, its weight in each category: at most FEATURES entries.
    weights: dict[int, tuple[float, ...]]
    #: For each category, weights of the earlier categories' log odds, and the bias.
    links: list[np.ndarray]
    biases: list[float]

    def word_scores(self, word: str) -> tuple[float, ...] | None:
        """A word's share in each category's score; None if it has none."""
        found = [w for f in features_of(word) if (w := self.weights.get(f)) is not None]
        return None if not found else found[0] if len(found) == 1 else tuple(map(sum, zip(*found, strict=True)))

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """From the sums of word scores (documents x categories)."""
        out = np.zeros_like(sums)
        logits: list[np.ndarray] = []
        for k in range(len(self.categories)):
            z = sums[:, k] + self.biases[k] + sum((w * x for w, x in zip(self.links[k], logits, strict=True)), np.zeros(len(sums)))
            out[:, k] = _sigmoid(z)
            logits.append(_squash(out[:, k]))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _squash(p: np.ndarray) -> np.ndarray:
    """Log odds, bounded: how an earlier probability enters a later model."""
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


class _Sparse:
    """Documents as lists of the features they hold (presence counted by words)."""

    def __init__(self, docs: list[np.ndarray], width: int):
        self.rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.cols = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
        self.n, self.width = len(docs), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.width)


def _fit(docs: list[np.ndarray], width: int, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated proximal steps: weights of features (with L1), of dense columns, bias."""
    x = _Sparse(docs, width)
    n = max(1, x.n)
    cells, times = np.unique(x.rows * width + x.cols, return_counts=True)
    square = np.bincount(cells % max(1, width), times.astype(float) ** 2, width) / n
    del cells, times
    scale = 1 / np.sqrt(np.maximum(square, 1 / n))  # columns of one length, so that rare words are learned as fast as common ones
    dot = lambda w: x.dot(w * scale)
    back = lambda g: x.back(g) * scale
    top = np.ones(width) / np.sqrt(max(1, width))
    for _ in range(12):  # largest eigenvalue, for the step
        top = back(dot(top)) / n
        most = float(np.linalg.norm(top)) or 1.0
        top /= most
    rate = 4.0 / (1.2 * most + 1 + (dense**2).mean(axis=0).sum())
    w, v, b = np.zeros(width), np.zeros(dense.shape[1]), 0.0
    pw, pv, pb, t = w, v, b, 1.0
    for _ in range(ROUNDS):
        g = (_sigmoid(dot(pw) + dense @ pv + pb) - y) / n
        nw = pw - rate * (back(g) + L2 * pw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * L1, 0)
        nv, nb = pv - rate * (dense.T @ g + L2 * pv), pb - rate * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pv, pb = nw + (t - 1) / s * (nw - w), nv + (t - 1) / s * (nv - v), nb + (t - 1) / s * (nb - b)
        w, v, b, t = nw, nv, nb, s
    return w * scale, v, b


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """docs: hashed features of each document, once for each distinct word; labels: documents x categories, 0 or 1."""
    if not docs:
        return Chain(categories, {}, [np.zeros(k) for k in range(len(categories))], [-40.0] * len(categories))
    names, numbers = np.unique(np.concatenate(docs), return_inverse=True)
    docs = np.split(numbers.astype(np.int32), np.cumsum([len(d) for d in docs])[:-1])
    del numbers
    held = [np.unique(d) for d in docs]
    flat, sizes = np.concatenate(held), [len(h) for h in held]
    del held
    n = np.bincount(flat, minlength=len(names)).astype(float)
    told = np.zeros(len(names))
    for k in range(len(categories)):
        y = labels[:, k]
        share = y.mean()
        told = np.maximum(told, (np.bincount(flat, np.repeat(y, sizes), len(names)) - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9))
    del flat
    told[n < LEAST_DOCS] = -1
    stay = np.sort(np.argsort(-told, kind="stable")[:FEATURES])
    stay = stay[told[stay] >= 0]
    number = np.full(len(names), -1)
    number[stay] = np.arange(len(stay))
    docs = [(m := number[d])[m >= 0] for d in docs]
    weights = np.zeros((len(categories), len(stay)))
    links: list[np.ndarray] = []
    biases: list[float] = []
    fold = np.arange(len(docs)) % FOLDS
    before = np.zeros((len(docs), 0))
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        out = np.zeros(len(docs))
        for f in range(FOLDS if k < len(categories) - 1 else 0):  # nothing follows the last category
            inside = np.flatnonzero(fold != f)
            w, v, b = _fit([docs[i] for i in inside], len(stay), before[inside], y[inside])
            at = np.flatnonzero(fold == f)
            out[at] = _Sparse([docs[i] for i in at], len(stay)).dot(w) + before[at] @ v + b
        w, v, b = _fit(docs, len(stay), before, y)
        weights[k] = w
        links.append(v)
        biases.append(float(b))
        before = np.column_stack([before, _squash(_sigmoid(out))])
    used = {int(names[s]): tuple(weights[:, j].tolist()) for j, s in enumerate(stay) if weights[:, j].any()}
    return Chain(categories, used, links, biases)


def train(
    documents: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, seed: int = 1
) -> Chain:
    """Fit on at most ``rows`` labelled documents, the first by a hash of their identifier, half of them of each value of the last
    category if there are so many, of texts of at most TRAIN_CHARS characters. ``labels`` has the identifier and one column
    of 0 and 1 for each category; rows with a null in it, and documents without text, are passed over. Of several labels
    of one document the larger counts in each category; of several texts the smallest."""
    small_batches(documents.sparkSession)
    last = categories[-1]
    kinds = {c: F.col(f"`{c}`").cast("int") for c in categories}
    clean = labels.select(F.col(f"`{id_col}`").alias("__id"), *(k.alias(c) for c, k in kinds.items())).dropna()
    clean = clean.groupBy("__id").agg(*(F.max(f"`{c}`").alias(c) for c in categories))
    half = lambda v: first_by_hash(clean.where(F.col(f"`{last}`") == v), F.col("__id"), rows // 2, seed)
    # At most ``rows`` narrow rows.
    picked = F.broadcast(half(1).unionByName(half(0)))
    text = documents.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where(F.length("__text") <= TRAIN_CHARS)
    one = text.join(picked, "__id").groupBy("__id").agg(F.min(F.struct("__text", *(F.col(f"`{c}`") for c in categories))).alias("__one"))
    met = one.select("__id", F.col("__one.__text").alias("__text"), *(F.col("__one").getField(c).alias(c) for c in categories))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[f for w in words_of(x) for f in features_of(w)] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]], names=out.fieldNames())

    out = T.StructType([met.schema["__id"], *columns(features="int[]"), *(T.StructField(c, T.IntegerType()) for c in categories)])

    def fit(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("__id").reset_index(drop=True)
        chain = fit_chain([np.asarray(f, dtype=np.int32) for f in got["features"]], got[categories].to_numpy(dtype=float), categories)
        return pd.DataFrame({"chain": [pickle.dumps(chain)]})

    # The sample is bounded, so one task can hold it; the driver gets the fitted weights only.
    made = met.mapInArrow(run, out).withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(fit, "chain binary").collect()
    return pickle.loads(made[0]["chain"]) if made else fit_chain([], np.zeros((0, len(categories))), categories)


def keep_clean(df: DataFrame, chain: Chain, text_col: str = "text", category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose probability of the category is below the threshold, all columns as they were."""
    scored = score(df, chain, text_col=text_col, carry=True)
    return scored.where(F.col(f"p_{category}") < threshold).select(*(F.col("__row").getField(c).alias(c) for c in df.columns))


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: its identifier (with ``carry`` all its columns, as ``__row``) and ``p_<category>`` for each category.

    Defined cases: a null or empty text has no words and gets the models' bias; texts are read whole; repeated rows and
    null identifiers are rows of their own; an empty table gives an empty result; other columns are not read.
    """
    schema = columns(**{f"p_{c}": "double" for c in chain.categories})
    kept: dict[str, tuple[float, ...] | None] = {}

    def work(texts: list[str]) -> pd.DataFrame:
        sums = np.zeros((len(texts), len(chain.categories)))
        for i, text in enumerate(texts):
            told = []
            for w in words_of(text):
                if w in kept:
                    s = kept[w]
                else:
                    if len(kept) >= CACHE_WORDS:
                        kept.clear()
                    s = kept[w] = chain.word_scores(w)
                if s is not None:
                    told.append(s)
            if told:
                sums[i] = np.sum(told, axis=0)
        p = chain.probabilities(sums)
        return pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(chain.categories)})

    return map_texts(df, id_col, text_col, work, schema, carry=carry)

"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

The trees are fitted in one task from a bounded, hash-ordered sample of labelled URLs: second-order boosting of the
logistic loss over binned features. Features are lengths, depth, digit ratio, entropy, counts of parameters and marks,
and what the labelled URLs say of a host's suffixes. The labels of a training row's whole host are left out of its own
suffix statistics, so the trees learn how far suffixes tell of hosts that no label names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import first_by_hash

#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Longest URL that is trained on.
TRAIN_CHARS = 2_000
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, RIDGE = 60, 4, 0.2, 32, 5.0, 1.0
#: Weight of the overall share in a suffix's share.
PRIOR = 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VOWELS = re.compile("[aeiou]")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """The longest rule that fits: its host is the URL's or one of its parents, its path begins the URL's path."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: -len(r.name)):
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        at = 0
        while True:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                return best


FEATURES = (
    "url length", "host length", "path length", "depth", "digit ratio", "entropy", "parameters", "parameter length", "host labels", "hyphens in host",
    "vowel ratio of host", "fragment", "file ending", "secure", "first label length", "share of last label", "share of last two labels", "share of first label",
)


def _lexical(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    counts = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), path.count("/"), sum(counts[c] for c in "0123456789") / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
        query.count("=") + query.count("&"), len(query), host.count(".") + 1, host.count("-"), len(_VOWELS.findall(host)) / max(1, len(host)),
        "#" in url, "." in path.rpartition("/")[2], url[:8].lower() == "https://", len(host.partition(".")[0]),
    ]


def _suffixes(host: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), "^" + labels[0]


@dataclass
class Trees:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    #: Complete binary trees: feature, bin (goes left if the value's bin is at most that) of inner nodes; values of leaves.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self._bins(x)
        wide = BINS + 1
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, wide)
            for level in range(DEPTH):
                n = 2**level
                best = np.full(n, 1e-9)
                for j in range(x.shape[1]):
                    key = node * wide + bins[:, j]
                    gl = np.cumsum(np.bincount(key, g, n * wide).reshape(n, wide), axis=1)
                    hl = np.cumsum(np.bincount(key, h, n * wide).reshape(n, wide), axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(n), at]
                    for k in np.flatnonzero(top > best):
                        best[k], feature[n - 1 + k], cut[n - 1 + k] = top[k], j, at[k]
                inner = n - 1 + node
                node = 2 * node + (bins[np.arange(len(y)), feature[inner]] > cut[inner])
            gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
            leaf = -RATE * gs / (hs + RIDGE)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of the positive class."""
        bins, rows, out = self._bins(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                inner = 2**level - 1 + node
                node = 2 * node + (bins[rows, feature[inner]] > cut[inner])
            out += leaf[node]
        return out


@dataclass
class UrlModel:
    trees: Trees
    share: float
    #: (labelled, blocked) by suffix, of the training sample: at most three for each of its rows.
    suffixes: dict[str, tuple[int, int]]

    @classmethod
    def fit(cls, urls: list[tuple[str, str, str]], blocked: list[bool]) -> UrlModel:
        """urls: (url, host, path)."""
        if not urls:
            return cls(Trees(), 0.0, {})
        y = np.array(blocked, dtype=float)
        n, b, hosts, bad = Counter(), Counter(), Counter(), Counter()
        for (_, host, _), v in zip(urls, blocked, strict=True):
            hosts[host] += 1
            bad[host] += bool(v)
            for s in set(_suffixes(host)):
                n[s] += 1
                b[s] += bool(v)
        made = cls(Trees(), float(y.mean()), {s: (n[s], b[s]) for s in n})
        x = made.features(urls, {h: (hosts[h], bad[h]) for h in hosts})
        made.trees.fit(x, y)
        return made

    def features(self, urls: list[tuple[str, str, str]], own: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
        """own: (labelled, blocked) by host, of hosts whose labels are to be left out of their own features."""
        rows = []
        for url, host, path in urls:
            row = _lexical(url, host, path)
            less, bad = own.get(host, (0, 0)) if own else (0, 0)
            for s in _suffixes(host):
                n, b = self.suffixes.get(s, (0, 0))
                n, b = n - less, b - bad
                row.append((b + PRIOR * self.share) / (n + PRIOR))
            rows.append(row)
        return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))

    def blocks(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        """Log odds that a URL is to be blocked; without any labelled URL all are allowed."""
        return self.trees.score(self.features(urls)) if self.trees.trees else np.full(len(urls), -np.inf)


def train(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", rows: int = TRAIN_ROWS, seed: int = 1) -> UrlModel:
    """Fit on at most ``rows`` labelled URLs, the first by a hash of the URL, in one task; rows without URL or label, and URLs
    of more than TRAIN_CHARS characters, are passed over.

    Copies of a URL with the same label count once, so a frequent URL doesn't take the places of others.
    """
    url = F.col(f"`{url_col}`")
    picked = labelled.select(url.alias("u"), host_of(url).alias("h"), path_of(url).alias("p"), F.col(f"`{blocked_col}`").cast("boolean").alias("b"))
    sample = first_by_hash(picked.where((F.length("u") <= TRAIN_CHARS) & F.col("b").isNotNull()), F.col("u"), rows, seed)

    def fit(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["u", "b"])
        model = UrlModel.fit(list(zip(got["u"], got["h"], got["p"], strict=True)), got["b"].astype(bool).tolist())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    # The sample is bounded, so one task can hold it; the driver gets the model only.
    made = sample.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(fit, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else UrlModel.fit([], [])


def judge(df: DataFrame, rules: list[Rule], model: UrlModel | None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a URL: the identifier, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` (``allow`` or ``block``).

    ``verdict`` is the rule's, else the model's (null without a model); ``score`` is the model's log odds, null where a rule decides.

    Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule but one of an empty host,
    and is judged by its characters; repeated rows and null identifiers are rows of their own; an empty table gives an
    empty result; other columns are not read.
    """
    url = F.col(f"`{url_col}`")
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())])
    found = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [(u or "", h, p) for u, h, p in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            hits = [found.find(h, p) for _, h, p in urls]
            score: list[float | None] = [None] * len(urls)
            open_ = [i for i, r in enumerate(hits) if r is None]
            if model and open_:
                for i, s in zip(open_, model.blocks([urls[i] for i in open_]).tolist(), strict=True):
                    score[i] = s
            verdict = [r.verdict if r else None if s is None else "block" if s > 0 else "allow" for r, s in zip(hits, score, strict=True)]
            names = pa.array([r and r.name for r in hits], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), names, pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=out.fieldNames())

    return df.select(F.col(f"`{id_col}`").alias("__id"), url.alias("__url"), host_of(url).alias("__host"), path_of(url).alias("__path")).mapInArrow(run, out)


def labelled_by_rules(df: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """The URLs that a rule decides, as (url, blocked): labels that a curated list gives."""
    judged = judge(df.select(F.col(f"`{url_col}`").alias("u")), rules, None, "u", "u")
    return judged.where("rule IS NOT NULL").select(F.col("u").alias("url"), (F.col("verdict") == "block").alias("blocked"))

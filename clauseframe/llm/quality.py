"""Quality rules by repetition coverage.

For several lengths n, a window of n words is hashed from the window of n - 1 words (a rolling polynomial over
word numbers, modulo 2**64), all documents of a batch at once in numpy. Windows with equal hashes in one document
are compared word by word, so a collision can't count as a repeat. A word is covered if any window that occurs
twice or more holds it, first occurrence included; coverage is measured in characters. Lines are compared in full.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from clauseframe.llm.common import columns, map_texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")

#: In hundredths, the largest share of a document's word characters inside repeated windows of n words, and of its line characters in repeated lines.
MOST_COVERED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST_IN_LINES = 20
#: The base rules: words at least, window, share of words inside repeated windows in hundredths.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Characters of the texts that are worked on at once.
CHUNK_CHARS = 2_000_000

SCHEMA = columns(
    n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long", dup_line_chars="long", line_chars="long",
    dup_ngram_chars="long[]", base_failed="boolean", kept="boolean",
)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _covered(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that its document holds twice or more. hashes: of the windows at each word."""
    last = len(ids) - n + 1
    inside = np.zeros(len(ids), dtype=bool)
    if last <= 0:
        return inside
    at = np.flatnonzero(doc[:last] == doc[n - 1 :])  # windows don't cross documents
    if not len(at):
        return inside
    keys = hashes[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    same = keys[1:] == keys[:-1]
    if same.any():
        a, b = at[:-1][same], at[1:][same]
        equal = doc[a] == doc[b]
        for j in range(n):
            equal &= ids[a + j] == ids[b + j]
        if not equal.all():  # a collision: count these windows by their words
            starts = np.unique(np.concatenate([a, b]))
            words = {}
            for s in starts.tolist():
                words.setdefault((int(doc[s]), *ids[s : s + n].tolist()), []).append(s)
            hit = np.array([s for v in words.values() if len(v) > 1 for s in v], dtype=np.int64)
        else:
            hit = np.concatenate([a, b])
        steps = np.zeros(len(ids) + 1, dtype=np.int32)
        hit = np.unique(hit)
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + n, -1)
        inside = np.cumsum(steps[:-1]) > 0
    return inside


def measure(texts: list[str]) -> pd.DataFrame:
    """The columns of ``SCHEMA`` for some texts (none of them null)."""
    lines = np.zeros((len(texts), 3), dtype=np.int64)  # repeated lines, their characters, all lines' characters
    words: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    symbols = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = _WORD.findall(text)
        counts[i] = len(found)
        words += found
        symbols[i] = len(_SYMBOLS.findall(text))
        seen: set[str] = set()
        for line in text.split("\n"):
            if _WORD.search(line):
                lines[i, 2] += len(line)
                if line in seen:
                    lines[i, 0] += 1
                    lines[i, 1] += len(line)
                else:
                    seen.add(line)
    ids, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, dtype=np.int64), [])
    chars = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))[ids] if len(ids) else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    total = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
    word_chars = total(chars)
    repeat_words = np.zeros(len(texts), dtype=np.int64)
    covered = np.zeros((len(texts), len(MOST_COVERED)), dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = mixed ^ (mixed >> np.uint64(31))
        word = hashes
        for n in range(2, max(*MOST_COVERED, WINDOW) + 1):
            hashes = hashes[:-1] * _MULTIPLIER + word[n - 1 :] if len(word) >= n else hashes[:0]
            if n in MOST_COVERED or n == WINDOW:
                inside = _covered(ids, doc, hashes, n)
                if n in MOST_COVERED:
                    covered[:, list(MOST_COVERED).index(n)] = total(chars * inside)
                if n == WINDOW:
                    repeat_words = total(inside)
    failed = (counts < LEAST_WORDS) | (100 * repeat_words > MOST_REPEATED * counts)
    good = (100 * covered <= np.array(list(MOST_COVERED.values())) * word_chars[:, None]).all(axis=1) & (100 * lines[:, 1] <= MOST_IN_LINES * lines[:, 2])
    return pd.DataFrame({
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 0], "n_repeat_words": repeat_words,
        "dup_line_chars": lines[:, 1], "line_chars": lines[:, 2], "dup_ngram_chars": list(covered), "base_failed": failed, "kept": good & ~failed,
    })


def repetition_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its identifier and the measures of ``SCHEMA``; ``dup_ngram_chars`` follows ``MOST_COVERED``.

    Defined cases: a null or empty text has no words and fails; a text is measured whole, whatever its length; ties,
    repeated rows and null identifiers are rows of their own; an empty table gives an empty result; other columns are
    not read.
    """
    return map_texts(df, id_col, text_col, measure, SCHEMA, CHUNK_CHARS)

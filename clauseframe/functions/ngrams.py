"""Hashed character n-grams of texts, counted in numpy: the features of weighted embeddings and of the language model."""

from __future__ import annotations

import numpy as np

#: Buckets of n-grams, and the multipliers of their three code points: a fixed rule, so that a table of weights stays valid.
BUCKETS = 512
MULTIPLIERS = (1_000_003, 8_191, 31)


def code_points(text: str | None) -> np.ndarray:
    """A text's code points, A to Z in lower case, with a space at both ends."""
    codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where((codes >= 65) & (codes <= 90), codes + 32, codes)


def buckets(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """The bucket of every three characters in a row; an empty text has none."""
    c = code_points(text)
    a, b, d = MULTIPLIERS
    return (c[:-2] * a + c[1:-1] * b + c[2:] * d) % size if text else np.zeros(0, dtype=np.int64)


def counts(text: str | None, size: int = BUCKETS) -> np.ndarray:
    return np.bincount(buckets(text, size), minlength=size)

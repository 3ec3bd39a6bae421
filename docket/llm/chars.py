"""Texts as arrays of characters, and labelled rows, for the classifiers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each character of the basic plane is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of others than letters is one space, also at
    both ends. Characters beyond the basic plane count as no letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 1 << 16, code, SPACE)
    code = np.where(_letters()[code], code, SPACE).astype(np.uint32)
    code = np.concatenate([[SPACE], code, [SPACE]]).astype(np.uint32)
    blank = code == SPACE
    return code[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def ngrams(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed n-grams of consecutive characters, ``bits`` wide."""
    if len(code) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(code) - n + 1, n, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ code[k: len(code) - n + 1 + k]
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def held_out(doc_id: Column) -> Column:
    """Rows from which nothing is learnt: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def share(doc_id: Column) -> Column:
    """A number in [0, 1) that follows from the id: rows below f are a sample of about that share."""
    return F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

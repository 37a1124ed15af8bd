"""Helpers shared by the corpus operators: tables, shared storage, hashing of bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.shared import cut, discard, mark, new_folder, partitions, release, settle, shared_dir  # noqa: F401

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


# --- byte hashing, vectorised -------------------------------------------------------------------

_rng = np.random.default_rng(20240601)
#: Random 64-bit values by byte; odd, so that no byte is absorbed.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.cumprod(np.full(size - 1, base, np.uint64))
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of BYTE[raw[k]] * BASE**k for i <= k < j, modulo 2**64."""
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each span [start, end) of the bytes behind prefix_hash c; its length is mixed in."""
    h = (c[end] - c[start]) * powers(INVERSE, len(c))[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

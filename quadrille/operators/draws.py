"""Random numbers that depend on keys and counters alone, so any task, engine or retry draws the same.

A stream's base is the first 32 bits of the MD5 of its keys; its numbers are the base plus multiples of an odd constant, put
through a 32-bit finaliser. The same arithmetic can be written in SQL, which is how results of simulations are checked.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# The step of a stream and the multipliers of the finaliser (public constants of well-known hashes).
STEP, MULTIPLIERS = 0x9E3779B9, (0x85EBCA6B, 0xC2B2AE35)


def base(*keys) -> int:
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def base_column(*keys) -> Column:
    """The base of a stream whose keys are columns, or literals of other kinds."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashes(base, counter) -> np.ndarray:
    """32-bit numbers of streams (broadcast against their counters)."""
    mask, s16, s13 = np.uint64(MASK), np.uint64(16), np.uint64(13)
    x = (np.asarray(base).astype(np.uint64) + np.asarray(counter).astype(np.uint64) * np.uint64(STEP)) & mask
    x = ((x ^ (x >> s16)) * np.uint64(MULTIPLIERS[0])) & mask
    x = ((x ^ (x >> s13)) * np.uint64(MULTIPLIERS[1])) & mask
    return x ^ (x >> s16)


def uniforms(base, counter) -> np.ndarray:
    """Numbers in the open unit interval."""
    return (hashes(base, counter).astype(np.float64) + 0.5) / 2.0**32


def permutations(base, first, n: int) -> np.ndarray:
    """Orders of n things by their numbers, counted on from each of first; ties keep their order."""
    counter = np.asarray(first)[..., None] + np.arange(n)
    return np.argsort(hashes(np.asarray(base)[..., None], counter), axis=-1, kind="stable")

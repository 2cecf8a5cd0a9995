"""Pieces that several corpus operators share: hashing of words and shingles, shared storage, batches.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; the separators are single bytes of UTF-8,
so all of this works on bytes, for a whole Arrow batch at once.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, ship, stored  # noqa: F401

SHINGLE_WORDS = 5
#: Bytes of text that are hashed at once (a longer single text is a piece of its own).
PIECE_BYTES = 500_000
NULL_ID = -(1 << 63)
FAN = 32

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # lower-cases A-Z
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (splitmix64), so that every bit of the result is usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 65536)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def encode(text) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sep = np.ones(len(buf) + 2, bool)
    sep[1:-1] = _SEP[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, first word of each text and the total at the end)."""
    buf = np.frombuffer(b"\n".join(raw), np.uint8)
    s, e = word_spans(buf)
    up, down = _pow_tables(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=c[1:])
    h = mix64((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64) * _MIX[0])
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.concatenate([[0], np.cumsum(lens + 1)])
    return h, np.searchsorted(s, begins).astype(np.int64)


def pieces(texts: Iterable, limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts with about limit bytes each: (position of the first, texts)."""
    at, run, size = 0, [], 0
    for k, t in enumerate(texts):
        b = encode(t)
        if run and size + len(b) > limit:
            yield at, run
            at, run, size = k, [], 0
        run.append(b)
        size += len(b)
    if run:
        yield at, run


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in text order, and the first one of each text (with the end).

    A text of 1 to n-1 words has its whole sequence as its only shingle; one without words has none.
    """
    counts = np.diff(bounds)
    if len(words) >= n:
        acc = words[: len(words) - n + 1] * _MIX[1]
        for j in range(1, n):
            acc = acc + words[j : len(words) - n + 1 + j] * _MIX[1 + j]
    else:
        acc = np.zeros(0, np.uint64)
    acc = mix64(acc)
    number = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros(first[-1], np.uint64)
    full = counts >= n
    if full.any():
        src = np.repeat(bounds[:-1][full] - first[:-1][full], number[full])
        pos = _ranges(first[:-1][full], number[full])
        out[pos] = acc[pos + src]
    for d in np.flatnonzero((counts > 0) & ~full):
        w = words[bounds[d] : bounds[d + 1]]
        with np.errstate(over="ignore"):
            v = (w * _MIX[1 : 1 + len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)) * _MIX[9]
        out[first[d]] = mix64(np.array([v], np.uint64))[0]
    return out, first


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated start[i], start[i]+1, ... of size[i] numbers each."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


def shingle_sets(texts: Iterable) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the text, its sorted distinct shingle hashes)."""
    for at, run in pieces(texts):
        h, first = shingle_hashes(*word_hashes(run))
        for k in range(len(run)):
            yield at + k, np.unique(h[first[k] : first[k + 1]])


def tune(spark: SparkSession) -> None:
    """Called where a query or stage begins: the package on the executors, and Arrow batches of bounded rows and bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    shared_dir(spark)


def tables(sf_dir: str, spark: SparkSession, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def fold(column: str = "doc_id", folds: int = 10):
    """crc32 of the id as text, modulo folds; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release_memory() -> None:
    """Gives memory that is free inside a Python worker back to the machine: workers live on, and one after the other holds its peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run):
    """A function for mapInArrow or mapInPandas that releases memory at the end of each task; Arrow takes it from the system."""

    @functools.wraps(run)
    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def releasing_group(run):
    """The same for a grouped function of key and frame (or frames), at the end of each group."""

    def group(key, frame):
        try:
            return run(key, frame)
        finally:
            release_memory()

    def cogroup(key, left, right):
        try:
            return run(key, left, right)
        finally:
            release_memory()

    return functools.wraps(run)(cogroup if len(inspect.signature(run).parameters) == 3 else group)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def texts_of(batch, column: str = "text") -> list:
    """The texts of an Arrow batch; null is None."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def with_columns(batch, keep: list[str], names: list[str], columns: list) -> pa.RecordBatch:
    """Columns of a batch, as they are, and new ones behind them. Arrow leaves ids, nulls and times unchanged; pandas would not."""
    kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*kept, *columns], names=[*keep, *names])


def ordered_buckets(df: DataFrame, key: str, tie: Column, rows_per_bucket: int, most: int) -> tuple[int, Column]:
    """(number of buckets, bucket of a row), ascending in (key, tie); about rows_per_bucket rows each, and not over most buckets.

    key is a whole number, null counts as least; tie is a 64-bit hash that orders rows of the same key. A key with more rows than
    a bucket should have is dealt to several by tie. The driver sees one number for each bucket.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = min(most, max(1, -(-rows // rows_per_bucket)))
    x = F.coalesce(F.col(key), F.lit(NULL_ID))
    cuts: list[int] = []
    if n > 1:
        at = F.percentile_approx(x, [k / n for k in range(1, n)], 20 * n)
        cuts = sorted(df.agg(at.alias("c")).first()["c"] or [])
    levels = [cuts]
    while len(levels[0]) > FAN:
        levels.insert(0, levels[0][FAN - 1 :: FAN])

    def cuts_before(stop) -> Column:
        """The number of cuts for which stop holds, by descending through levels of FAN cuts each."""
        out = F.lit(0)
        for level in levels:
            here = F.array(*map(F.lit, level)).cast("array<bigint>") if level else F.array().cast("array<bigint>")
            out = out * FAN + F.size(F.filter(F.slice(here, out * FAN + 1, FAN), stop))
        return out

    if len(set(cuts)) == len(cuts):
        return n, cuts_before(lambda c: c < x)
    below, same = cuts_before(lambda c: c < x), cuts_before(lambda c: c <= x)
    part = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(NULL_ID)), 33).cast("double") / F.lit(float(1 << 31))
    return n, below + F.floor(part * (same - below)).cast("int")

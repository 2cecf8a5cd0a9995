"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by their number of shingles, in classes that double. For a class of items of up to L
shingles, every text is covered by windows of 2L shingle positions at every L-th one, so an item lies in one window whole
and makes up at least a quarter of it, however long the text is. Items and windows are summarised by one-permutation
MinHash (the least hash in each of a number of bins); an equal bin makes an item a candidate, which asks for a
single hit of many likely ones. Every candidate is then verified on the shingle sets of the whole text and item: it
counts if the text holds ``CONTAINMENT`` of the item's distinct shingles or more.

A sketch can miss an item of few shingles, as each may share its bin with a smaller hash of the window. So items of up to
``DIRECT`` shingles are found by the shingles themselves: one that is contained misses a quarter of its n shingles at
most, so any n // 4 + 1 of them include one that the text has, and all shingles of a text are looked up. Nothing is
missed there. Classes above have bins enough for the rest.

Items are the query set. They are read in blocks of bounded size, each of which is sent to all tasks and searched
against all rows. Null and empty items match nothing; an item of one to four words has its whole sequence as
its only shingle, so it matches only texts that equal it, and likewise for short texts. Repeated items and rows are
treated one by one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import encode, mix64, pieces, releasing, shingle_hashes, shingle_sets, texts_of, word_hashes

CONTAINMENT = 0.75
DIRECT = 16
#: The sieve in front of a table of keys has about so many places for each, in these bounds.
SIEVE, SIEVE_BITS = 16, (10, 26)
BLOCK_BYTES = 16_000_000


class Index:
    """The items of one block."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.sets = [s for _, s in shingle_sets(texts)]
        classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                size = DIRECT
                while size < len(s):
                    size *= 2
                classes.setdefault(size, []).append(k)
        self.direct = self._direct(classes.pop(DIRECT, []))
        self.classes = []
        for size, items in sorted(classes.items()):
            bins = self._bins(size)
            keys = []
            for k in items:
                mins = self._mins(self.sets[k], np.zeros(len(self.sets[k]), np.int64), 1, bins)
                keys.append(self._keys(mins, bins))
            self.classes.append((size, bins, *self._table(keys, items)))

    def _direct(self, items: list[int]):
        """Table of n // 4 + 1 shingles of each item of n, those that fewest of these items have."""
        if not items:
            return None
        seen, count = np.unique(np.concatenate([self.sets[k] for k in items]), return_counts=True)
        keys = []
        for k in items:
            s = self.sets[k]
            keys.append(s[np.argsort(count[np.searchsorted(seen, s)], kind="stable")[: len(s) // 4 + 1]])
        return self._table(keys, items)

    @staticmethod
    def _table(keys: list[np.ndarray], items: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, the item of each, and a sieve of their highest bits."""
        owner = np.repeat(items, [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        low, high = SIEVE_BITS
        bits = min(high, max(low, (SIEVE * len(keys)).bit_length()))
        sieve = np.zeros(1 << bits, bool)
        sieve[keys >> np.uint64(64 - bits)] = True
        return keys[order], owner[order], sieve

    @staticmethod
    def _bins(size: int) -> int:
        """Two bins for each shingle of a window of a small class; half a bin in the largest, whose items have many."""
        return max(size, min(4 * size, 256))

    @staticmethod
    def _mins(h: np.ndarray, group: np.ndarray, groups: int, bins: int) -> np.ndarray:
        """Least hash of every group in every bin; the largest number where a bin is empty."""
        out = np.full(groups * bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(out, group * bins + (h & np.uint64(bins - 1)).astype(np.int64), h)
        return out.reshape(groups, bins)

    @staticmethod
    def _keys(mins: np.ndarray, bins: int) -> np.ndarray:
        return mix64(mins[mins != np.iinfo(np.uint64).max] + np.uint64(bins))

    @staticmethod
    def _hits(k: np.ndarray, keys: np.ndarray, owner: np.ndarray, sieve: np.ndarray):
        """(place in k, items that have this key) of every key that the table has."""
        hit = np.flatnonzero(sieve[k >> np.uint64(65 - len(sieve).bit_length())])
        lo, hi = np.searchsorted(keys, k[hit], "left"), np.searchsorted(keys, k[hit], "right")
        for j in np.flatnonzero(hi > lo).tolist():
            yield hit[j], owner[lo[j] : hi[j]].tolist()

    def search(self, texts) -> list[tuple[int, int, int]]:
        """(text, item, number of the item's shingles that the text has) of every match."""
        out = []
        for at, run in pieces(texts):
            h, first = shingle_hashes(*word_hashes(run))
            counts = np.diff(first)
            text_of = np.repeat(np.arange(len(run)), counts)
            place = np.arange(len(h)) - first[text_of]
            found: set[tuple[int, int]] = set()
            if self.direct is not None:
                for j, items in self._hits(h, *self.direct):
                    found.update((int(text_of[j]), o) for o in items)
            for size, bins, *table in self.classes:
                blocks = -(-counts // size)
                begin = np.concatenate([[0], np.cumsum(blocks)])
                if not begin[-1]:
                    continue
                mins = self._mins(h, begin[text_of] + place // size, begin[-1], bins)
                last = begin[1:][blocks > 0] - 1
                joined = np.minimum(mins, np.concatenate([mins[1:], mins[-1:]]))
                joined[last] = mins[last]
                window, _ = np.nonzero(joined != np.iinfo(np.uint64).max)
                for j, items in self._hits(self._keys(joined, bins), *table):
                    t = int(np.searchsorted(begin, window[j], "right")) - 1
                    found.update((t, o) for o in items)
            sets: dict[int, np.ndarray] = {}
            for t, item in sorted(found):
                if t not in sets:
                    sets[t] = np.unique(h[first[t] : first[t + 1]])
                want = self.sets[item]
                where = np.minimum(np.searchsorted(sets[t], want), len(sets[t]) - 1)
                shared = int((sets[t][where] == want).sum())
                if shared >= CONTAINMENT * len(want):
                    out.append((at + t, item, shared))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """Indexes of the items, in blocks of about block_bytes of text."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(encode(r["t"]))
        if size >= block_bytes:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of every pair of a text and an item it holds."""
    doc_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_kind}, item_id {item_kind}, n_item long, n_shared long, containment double"
    narrow, parts, item_type = docs.select("doc_id", "text"), [], to_arrow_type(items.schema["item_id"].dataType)
    for index in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                index = shared.value
                if found := index.search(texts_of(batch)):
                    texts, items, shared_n = (list(x) for x in zip(*found, strict=True))
                    sizes = [len(index.sets[k]) for k in items]
                    share = [n / size for n, size in zip(shared_n, sizes, strict=True)]
                    columns = [batch.column(0).take(pa.array(texts)), pa.array([index.ids[k] for k in items], item_type), pa.array(sizes, pa.int64()), pa.array(shared_n, pa.int64()), pa.array(share)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        parts.append(narrow.mapInArrow(releasing(run), schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def remove_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item; all columns stay as they are."""
    for index in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[t for t, _, _ in shared.value.search(texts_of(batch, text_col))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs

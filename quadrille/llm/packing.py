"""Best-fit packing of documents into sequences of fixed length, with certified repacking.

Documents longer than a sequence are cut into full pieces and one shorter piece, the first. Full pieces are
sequences by themselves. The others are dealt to partitions of bounded size, and each partition is packed by
best-fit decreasing. Dual-feasible functions bound its number of bins from below: a partition that reaches its bound
is certified and only its emptiest bin goes on; one with a gap keeps its full bins and exchanges the
documents of the others with other partitions' in the next, smaller round, where best-fit decreasing runs again. Rounds end
when everything is certified, when a single partition is left that has been repacked, or when a round hardly leaves fewer
documents than the one before; that last round keeps what it makes.

Null and empty texts are documents of the end id alone. Rows are told apart by a number of their own, so repeated
and null ids are packed one by one; ids pass through unchanged. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, releasing_group, stored, texts_of
from .tokens import END_ID, encoder, in_runs

CAPACITY, PARTITION_PIECES = 1024, 16_384
#: A round that leaves more than this part of the documents of the one before is the last.
SHRINK = 0.8
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, fill of each bin). Among equally good bins the oldest takes the piece."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []  # bit r of rooms: some bin has room r
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return where, offset, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Best of the bounds that two families of dual-feasible functions give for the number of bins."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    upto, mass = np.cumsum(count), np.cumsum(count * x)
    for cut in range(1, capacity // 2 + 1):  # small pieces vanish, their complements fill a bin
        big = int(count.sum() - upto[capacity - cut])
        middle = int(mass[capacity - cut] - mass[cut - 1])
        best = max(best, big + -(-middle // capacity))
    for k in range(1, 33):  # rounds down to multiples of capacity / k, unless (k + 1) * x / capacity is whole
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def token_pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    kind = df.schema["doc_id"].dataType.simpleString()

    @releasing
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for a, b in in_runs(texts):
                ids, bounds = encoder(vocabulary).encode(texts[a:b], end)
                data = memoryview(ids.astype("<u4").tobytes())
                rows = []
                for i in range(b - a):
                    s, e = int(bounds[i]), int(bounds[i + 1])
                    first = (e - s) % capacity or capacity
                    cuts = [s, *range(s + first, e + 1, capacity)]
                    rows += [(a + i, k, p - s, q - p, zlib.crc32(data[4 * p : 4 * q])) for k, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False))]
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, _PIECE.format(id=kind))


def _packer(turn: int, last: bool, capacity: int):
    """Packs one partition and says which of its bins are final."""

    @releasing_group
    def one(key, f):
        f = f.sort_by([("length", "descending"), ("uid", "ascending")]).drop_columns("part")
        where, offset, fill = best_fit_decreasing(sizes := f["length"].to_numpy(), capacity)
        sure = len(fill) <= lower_bound(sizes, capacity)
        final = np.full(len(fill), last or sure) | (fill == capacity)
        if sure and not last:
            emptiest = int(fill.argmin())
            final[emptiest] = fill[emptiest] == capacity
        sequence = (np.int64(turn + 1) << 56) + (np.int64(key[0].as_py()) << 28) + where
        for name, column in (("sequence_id", sequence), ("offset", offset), ("certified", np.full(len(f), sure)), ("final", final[where])):
            f = f.append_column(name, pa.array(column))
        return f

    return one


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Adds sequence_id, offset and certified (its partition reached the lower bound) to a table of pieces.

    Reads pieces once; everything after that works on narrow rows in the shared folder.
    """
    base = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done = [base.filter(F.col("length") == capacity).select("*", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    left = base.filter(F.col("length") < capacity)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    turn, before = 0, None
    while n := left.count():
        parts = max(1, round(n / partition_pieces))
        last = turn > 0 and (parts == 1 or n > SHRINK * before)

        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInArrow(_packer(turn, last, capacity), f"{fields}, sequence_id long, offset long, certified boolean, final boolean"), f"packed{turn}")
        done.append(packed.filter("final").drop("final"))
        if last:
            break
        left = packed.filter("NOT final").select(base.columns)
        turn, before = turn + 1, n
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("uid")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places; see the module's text."""
    return pack(token_pieces(df, capacity, vocabulary, end), capacity)

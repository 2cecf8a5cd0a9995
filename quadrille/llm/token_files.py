"""Token ids in patched frame-of-reference shards.

A shard holds whole documents in order. Its ids are cut into blocks of ``BLOCK``; each block subtracts its minimum and
packs the rest at the width of its ``PERCENTILE``; ids that need more bits go to the block's exception list, and the
shard's index has the start of every block, so any block can be read alone. Layout, little-endian:

    magic "QPF2", u32 documents, u32 documents without an id (they come first), u64 ids, u32 blocks
    | i64 doc_id each | u32 length each
    | u32 minimum each block | u8 width each | u8 exceptions each | u64 start each
    | blocks: packed bits, exception places (u8), exception values (u32)

Shards are rows of a Parquet table in the shared folder, so Spark's commit protocol guards them against lost
executors and repeated tasks. Documents are dealt to ascending buckets of doc_id, each of which one task sorts, encodes and
writes; an id that holds very many rows gets several buckets. Rows with equal ids are ordered by a hash of their text. Null
texts count as empty; a document has its end id at least. A null doc_id counts as the least id and is kept as null. An empty
table makes no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_buckets, releasing, stored, texts_of
from .tokens import END_ID, encoder, in_runs

BLOCK, PERCENTILE, SHARD_IDS = 128, 90, 1_000_000
ROWS_PER_BUCKET, MAX_BUCKETS = 5000, 32**3
MAGIC, HEAD = b"QPF2", 24


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(minimum, width, exceptions, start of each block, all blocks). The last block repeats its last id up to its size."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64), b""
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[-1]
    x = x.reshape(n, BLOCK)
    low = x.min(axis=1)
    y = x - low[:, None]
    kth = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = _widths(np.partition(y, kth, axis=1)[:, kth])
    over = y.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    extra = over.sum(axis=1)
    size = width * (BLOCK // 8) + 5 * extra
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            out[start[rows][:, None] + np.arange(w * (BLOCK // 8))] = _pack(y[rows], w)
    row, col = np.nonzero(over)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        base = start[row] + width[row] * (BLOCK // 8)
        out[base + rank] = col
        values = np.ascontiguousarray(y[row, col].astype("<u4")).view(np.uint8).reshape(-1, 4)
        out[(base + extra[row] + 4 * rank)[:, None] + np.arange(4)] = values
    return low, width.astype(np.uint8), extra.astype(np.uint8), start.astype(np.uint64), out.tobytes()


def _pack(y: np.ndarray, w: int) -> np.ndarray:
    """Rows of numbers to their lowest w bits in little-endian 64-bit words."""
    words = np.zeros((len(y), BLOCK * w // 64), np.uint64)
    y = y.astype(np.uint64) & np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        k, shift = divmod(i * w, 64)
        words[:, k] |= y[:, i] << np.uint64(shift)
        if shift + w > 64:
            words[:, k + 1] |= y[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").view(np.uint8)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view("<u8")
    out = np.empty((len(raw), BLOCK), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        k, shift = divmod(i * w, 64)
        v = words[:, k] >> np.uint64(shift)
        if shift + w > 64:
            v = v | words[:, k + 1] << np.uint64(64 - shift)
        out[:, i] = v & mask
    return out


def unpack_blocks(low, width, extra, start, data: np.ndarray) -> np.ndarray:
    """All ids of the given blocks, the last one with its padding."""
    width, extra, start = width.astype(np.int64), extra.astype(np.int64), start.astype(np.int64)
    y = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            y[rows] = _unpack(data[start[rows][:, None] + np.arange(w * (BLOCK // 8))], w)
    row = np.repeat(np.arange(len(low)), extra)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        base = start[row] + width[row] * (BLOCK // 8)
        at = (base + extra[row] + 4 * rank)[:, None] + np.arange(4)
        y[row, data[base + rank]] = np.ascontiguousarray(data[at]).view("<u4")[:, 0]
    return (y + low.astype(np.uint32)[:, None]).reshape(-1)


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, without_id: int = 0) -> bytes:
    low, width, extra, start, data = pack_blocks(ids)
    head = MAGIC + np.array([len(doc_ids), without_id], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([len(low)], "<u4").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), low.astype("<u4").tobytes(), width.tobytes(), extra.tobytes(), start.astype("<u8").tobytes(), data])


def _sections(shard: bytes) -> tuple[int, int, list[np.ndarray]]:
    """(documents without an id, ids, [doc_ids, lengths, minima, widths, exceptions, starts, blocks])."""
    if shard[:4] != MAGIC:
        raise ValueError("not a shard of this format")
    docs, without_id, n, blocks = (int(np.frombuffer(shard, t, 1, at)[0]) for t, at in (("<u4", 4), ("<u4", 8), ("<u8", 12), ("<u4", 20)))
    at, parts = HEAD, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u4", blocks), ("u1", blocks), ("u1", blocks), ("<u8", blocks)):
        parts.append(np.frombuffer(shard, kind, count, at))
        at += parts[-1].nbytes
    return without_id, n, [*parts, np.frombuffer(shard, np.uint8, -1, at)]


def read_shard(shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a shard."""
    _, n, parts = _sections(shard)
    return parts[0], parts[1], unpack_blocks(*parts[2:])[:n]


def read_ids(shard: bytes, begin: int, end: int) -> np.ndarray:
    """The ids from begin to end of a shard; only the blocks that hold them are decoded."""
    _, n, (_, _, *index, data) = _sections(shard)
    begin, end = max(0, begin), min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = begin // BLOCK, -(-end // BLOCK)
    return unpack_blocks(*(x[a:b] for x in index), data)[begin - a * BLOCK : end - a * BLOCK]


def write_token_table(df: DataFrame, vocabulary: str | None = None, end: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenises documents in ascending doc_id order into shards; returns the stored table part, before, n_ids, payload.

    part ascends with doc_id; before counts the ids of the part's earlier shards. A shard ends with the document
    that reaches shard_ids.
    """
    narrow = df.select(df["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    buckets, part = ordered_buckets(narrow, "doc_id", F.col("tie"), ROWS_PER_BUCKET, MAX_BUCKETS)
    dealt = narrow.select(part.alias("part"), "doc_id", "tie", "text").repartitionById(buckets, "part")
    ordered = dealt.sortWithinPartitions("part", "doc_id", "tie").drop("tie")

    @releasing
    def run(batches):
        now, before, size = None, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        without_id = 0

        def flush():
            nonlocal before, size, without_id
            shard = write_shard(*(np.concatenate(x) for x in zip(*held, strict=True)), without_id)
            row = pa.record_batch({"part": pa.array([now], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([shard], pa.binary())})
            before, size, without_id = before + size, 0, 0
            held.clear()
            return row

        for batch in batches:
            parts, texts = batch.column(0).to_numpy(), texts_of(batch)
            no_id, doc_ids = batch.column(1).is_null().to_numpy(False), batch.column(1).fill_null(0).to_numpy(False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if parts[x] != now:
                    if held:
                        yield flush()
                    now, before = parts[x], 0
                for a, b in in_runs(texts[x:y]):
                    a, b = a + x, b + x
                    ids, bounds = encoder(vocabulary).encode(texts[a:b], end)
                    held.append((doc_ids[a:b], np.diff(bounds), ids))
                    size, without_id = size + len(ids), without_id + int(no_id[a:b].sum())
                    if size >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    return stored(ordered.mapInArrow(run, "part int, before long, n_ids long, payload binary"), "token-shards")


def read_token_table(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each bucket
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]] = at
        at += r["n"]

    @releasing
    def run(batches):
        for batch in batches:
            for part, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                without_id, n, (doc_ids, lengths, *blocks) = _sections(payload)
                bounds = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                data = memoryview(unpack_blocks(*blocks)[:n].astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                doc_ids = pa.array(doc_ids, pa.int64(), mask=np.arange(len(doc_ids)) < without_id)
                yield pa.record_batch({"doc_id": doc_ids, "start": pa.array(starts[part] + before + bounds[:-1], pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

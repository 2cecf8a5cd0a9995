"""SimHash near duplicates: segment popcounts as an embedding, a grid range-join in it, exact verification.

A fingerprint is cut into 32 segments of two bits, and its point has the number of ones of each as coordinates. One differing bit moves
the point by one step at most, so the Manhattan distance of two points never exceeds the Hamming distance of their fingerprints.
Fingerprints that differ in three bits or fewer therefore have points at distance three or less, and in one of the two halves
of the coordinates at distance one or less. The grid has a cell for each point of a half. Every fingerprint is kept in its two own
cells and looks into those one step up (of two cells one step apart, one is the lower), 26 on average. Who meets in a cell is tested for
the Manhattan distance of the whole points, then for the Hamming distance.

Cells can be crowded, as many near copies have points close together. First, members of a cell that fall into one part of it are linked
among themselves; this need not be complete. Then a cell in which all belong to one component needs nothing more, and in any other one
only those outside the cell's largest component meet the others. Crowded cells are dealt to tiles for that. So a large group of
near copies costs about its own size, and no pairs are written but one for each two components and batch.
The worst case, a crowded cell without links, is quadratic in its members, over many tasks.

Texts are read whole; null counts as empty. Texts without words have fingerprint zero, which links like any other. Equal texts (and
whatever has the same fingerprint) are one row while links are searched. A null id is no candidate for a component's least
id; a component without any id has null. Other columns are ignored; an empty table gives an empty one. A text's shingles are
hashed by 50,000, so long texts need no more memory than their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ranges, discard, encode, releasing, stored, texts_of, with_columns
from .components import connected_components

WORDS, SEED, MOST_DIFFERENT = 3, 42, 3
RUN_SHINGLES = 50_000
#: Members of a tile of a cell; members that are linked among themselves first, in cells of more than CROWDED.
TILE, FIRST_TILE, CROWDED = 2048, 256, 64
#: Rows and pairs that are worked on at once.
BATCH_ROWS, BATCH_PAIRS = 100_000, 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = 0x5555555555555555


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:  # sums of 255 rows fit a byte
        out += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def simhash(text) -> int:
    """The fingerprint of one text, unsigned; zero for a text without words."""
    line = b" ".join(encode(text).translate(_LOWER).split())  # splits where bytes 0x20 and 0x09 to 0x0D are
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(line)]])
    n = max(1, len(begin) - WORDS + 1)
    end = end[WORDS - 1 :] if len(end) >= WORDS else end[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, RUN_SHINGLES):
        spans = zip(begin[k : min(k + RUN_SHINGLES, n)].tolist(), end[k : k + RUN_SHINGLES].tolist(), strict=True)
        ones += _ones(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhashes(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every document."""
    docs = docs.select("doc_id", "text")

    @releasing
    def run(batches):
        for batch in batches:
            fps = np.fromiter(map(simhash, texts_of(batch)), np.uint64, batch.num_rows)
            yield with_columns(batch, ["doc_id"], ["fp"], [pa.array(fps.view(np.int64))])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _own_cells(fp: Column) -> Column:
    """The cells of both halves: 16 coordinates of two bits each; the second half's have bit 32 besides."""
    odd = F.lit(_ODD >> 32)
    halves = [F.shiftrightunsigned(fp, k).bitwiseAND(odd) + F.shiftrightunsigned(fp, k + 1).bitwiseAND(odd) for k in (0, 32)]
    return F.array(halves[0], halves[1].bitwiseOR(F.lit(1 << 32)))


def _cells_above(cell: Column) -> Column:
    """The cells one step up: a coordinate of zero or one has one more."""
    steps = F.array(*(F.lit(1 << 2 * j).cast("long") for j in range(16)))
    room = F.filter(steps, lambda s: cell.bitwiseAND(s * 2) == 0)
    return F.transform(room, lambda s: cell + s)


def _sorted_segments(fp: np.ndarray) -> np.ndarray:
    """Every segment with its ones first: the bits in which two of them differ are the points' Manhattan distance."""
    high = fp >> np.uint64(1)
    odd = np.uint64(_ODD)
    return ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of pairs that link: first by the lower bound, then exactly."""
    near = np.flatnonzero(np.bitwise_count(_sorted_segments(a) ^ _sorted_segments(b)) <= MOST_DIFFERENT)
    return near[np.bitwise_count(a[near] ^ b[near]) <= MOST_DIFFERENT]


def _distinct_links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.record_batch({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _meet(batches):
    """Links of the labels of probers with those of held rows of the same group.

    Rows are (group, group's part, role, fp, label), sorted: in every group those held (role 0) come before the probers (role 1). Only the
    last group's held rows are kept from one batch of rows to the next.
    """
    kept: list[np.ndarray] | None = None
    waiting, size = [], 0

    def work(cols):
        cell, tile, role, fp, label = cols
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(cell))))
        held = np.bincount(group[role == 0], minlength=len(new))
        probers = np.flatnonzero(role == 1)
        many = held[group[probers]]
        ends = np.cumsum(many)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, BATCH_PAIRS)))
        for x, y in zip(cuts, np.append(cuts[1:], len(probers)), strict=True):
            p, k = probers[x:y], many[x:y]
            i, j = np.repeat(p, k), _ranges(new[group[p]], k)
            other = np.flatnonzero(label[i] != label[j])
            i, j = i[other], j[other]
            hit = _linked(fp[i].view(np.uint64), fp[j].view(np.uint64))
            if len(hit):
                yield _distinct_links(label[i[hit]], label[j[hit]])
        last = (group == group[-1]) & (role == 0)
        return [c[last] for c in cols]

    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= BATCH_ROWS:
            kept = yield from work([np.concatenate(c) for c in zip(*([kept] if kept else []), *waiting, strict=True)])
            waiting, size = [], 0
    if size:
        yield from work([np.concatenate(c) for c in zip(*([kept] if kept else []), *waiting, strict=True)])


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")


def _grouped(rows: DataFrame) -> DataFrame:
    """Links found by rows of cell, tile, role, fp and label."""
    dealt = rows.select("cell", "tile", "role", "fp", "label").repartition("cell", "tile").sortWithinPartitions("cell", "tile", "role")
    return dealt.mapInArrow(releasing(_meet), "a long, b long")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect whatever is connected among distinct fingerprints (column fp)."""
    own = fps.select("fp", F.explode(_own_cells(F.col("fp"))).alias("cell"))
    # in parts of crowded cells, everyone with everyone: a row is held and prober at once
    crowded = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED)
    first = own.join(stored(crowded, "crowded"), "cell").withColumn("tile", _part(F.ceil(F.col("n") / FIRST_TILE)))
    first = first.select("cell", "tile", "fp", F.col("fp").alias("label"), F.explode(F.array(F.lit(0), F.lit(1))).alias("role"))
    inside = stored(_grouped(first).distinct(), "cell-links")
    # components of these, larger ones first in order
    labels = connected_components(inside)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    labels = labels.join(sizes, "label").select(F.col("node").alias("fp"), "label", "size")
    placed = fps.select("fp").join(labels, "fp", "left")
    placed = stored(placed.select("fp", F.coalesce("label", "fp").alias("label"), (-F.coalesce("size", F.lit(1))).alias("rank")), "placed")
    own = placed.select("fp", "label", "rank", F.explode(_own_cells(F.col("fp"))).alias("cell"))
    looks = F.concat(F.array(F.struct(F.col("cell"), F.lit(False).alias("probe"))), F.transform(_cells_above(F.col("cell")), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("probe"))))
    entries = own.select("fp", "label", "rank", F.explode(looks).alias("x")).select("x.*", "fp", "label", "rank")
    place = F.struct("rank", "label")
    cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("empty"), F.min(place).alias("main"), F.max(place).alias("other"))
    cells = cells.filter("NOT empty AND main != other").select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.col("main.label").alias("main"))
    met = entries.join(stored(cells, "open-cells"), "cell")
    mine = F.array(F.struct(F.lit(0).alias("role"), _part(F.col("tiles")).alias("tile")))
    every = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.lit(1).alias("role"), t.alias("tile")))
    roles = F.explode(F.when(F.col("label") == F.col("main"), mine).otherwise(F.concat(mine, every)))
    across = stored(_grouped(met.select("cell", "fp", "label", roles.alias("x")).select("cell", "fp", "label", "x.*")).distinct(), "links")
    return inside.union(across)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    rows = stored(simhashes(docs), "simhashes")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-simhashes")
    labels = connected_components(fingerprint_links(fps))
    placed = stored(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-labels")
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = stored(placed.join(least, "label").select("fp", "component_id"), "simhash-groups")
    discard(fps, placed)
    out = rows.join(groups, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

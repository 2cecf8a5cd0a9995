"""Exact Jaccard join of word-shingle sets by partition and pigeonhole.

Let J be 3/4. Sets of sizes r and s with similarity J or more differ in at most H = (r + s) / 7 elements. For every size
band, the universe of shingle hashes is dealt into segments by a hash; a signature is the hash of what a set has in a
segment. A set takes segments in their common order until those that are not empty outweigh H for its largest
possible partner. Whichever of two similar sets stops first, one of its weighed segments agrees in both, as each
disagreement uses up differences. A one-deletion segment also has the signatures of its content without one
element; if none agrees, two differences are used up, so it weighs double. A cost model picks, for each band, the mean
segment size and the share of one-deletion segments with the fewest rows and expected false meetings, given the part of all
shingles that is frequent in this corpus, which is measured. Where little is frequent, exact segments cost fewer rows; where
half is, large one-deletion segments win, as they seldom hold frequent shingles alone.

Frequent shingles are only a hint about cost: a segment made of them alone weighs nothing for its set and is emitted as a
side entry. Entries that were weighed meet all entries of their signature, side entries meet no other side entries; so
any hint gives the same result. The hint is counted over all texts, in the part of the hash order that signatures
come from, and its length is bounded by ``HINT_MAX``, most frequent first. A set that runs out of segments is short and
emits everything. Only two short sets can then miss each other, so signatures of short sets, and signatures that too
many sets share, join sets to clusters. A cluster is resolved exactly: all members against some pivots, then those
outside the largest part against all members, in blocks, keeping a spanning forest of the links found.

Candidates are ruled out by histograms of their hashes, whose distance bounds the sets' difference from below, and
verified on whole sets. Sets of documents with equal shingles are one node from the start, so copies
cost nothing. Hashes have 64 bits; links are exact up to their collisions.

Null and empty texts have an empty set and link with nothing. A null id is kept; it never names a component
if the component has another id. Repeated rows are copies of each other. Ids and other columns pass through unchanged, whatever
their names. Word rules: see ``common``.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, mix64, releasing, releasing_group, shingle_sets, stored, texts_of, with_columns
from .components import Forest, connected_components

#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: A shingle is frequent if more sets than this have it. Part of the hash order in which they are counted.
HINT_COUNT, HINT_MAX, HINT_PART = 10, 1_000_000, 0.7
BUCKET_SHINGLES, DIRECT_PAIRS = 1_000_000, 1024
#: Up to so many candidate sets (16 bytes each) are found among the texts by broadcast, more by shuffle.
BROADCAST_SETS = 1_000_000
PIVOTS, CHUNK, CHUNK_BYTES = 24, 512, 8_000_000
#: Parts that the narrow rows of a cluster of several chunks are dealt to where they are joined by cluster.
SALTS = 64
#: Rows that one false meeting of frequent segments is worth, and the options of the cost model: mean sizes of segments, and
#: parts of them that are one-deletion segments.
MEETING_COST = 20.0
MEAN_SIZES, DELETION_PARTS = (0.3, 0.5, 0.8, 1.0, 1.25, 1.6, 2.0, 2.5, 3.0, 4.0), (0.0, 0.1, 0.25, 0.5, 1.0)
#: Segments must suffice for sets of which this part is frequent.
RESERVE = 0.45
#: Elements for each cell of the histograms that rule out pairs before their sets are read.
CELL = 6
SIG_BYTES = 6


def differences(r: int, s: int) -> int:
    """Most elements in which similar sets of these sizes can differ."""
    return (100 - PERCENT) * (r + s) // (100 + PERCENT)


def largest_partner(n: int) -> int:
    return 100 * n // PERCENT


def band(n: int) -> int:
    """Sizes 1, 2-4, 5-16, 17-64 and so on."""
    return max(0, math.ceil(math.log(n, 4) - 1e-12))


@cache
def allocation(g: int, hot_share: float) -> tuple[int, int]:
    """(segments of band g, how many of them, the first ones, are one-deletion segments)."""
    top = 4**g
    if top <= 64:
        return 1 << 40, 0  # hardly two elements share a segment: one-deletion would have nothing to delete
    best = None
    for z in MEAN_SIZES:
        m = int(top / z)
        for share in DELETION_PARTS:
            cost = 0.0
            for n in (top // 4 + 1, top // 2, top):
                need, mean = differences(n, largest_partner(n)) + 1, n / m
                p0, p1 = math.exp(-mean), mean * math.exp(-mean)
                hot = math.exp(-mean * (1 - hot_share)) - p0
                d = int(share * m)
                double = (1 - p0 - hot) + (1 - p0 - p1) * (1 - hot_share)
                plain = 1 - p0 - hot
                cold, once = 1 - math.exp(-mean * (1 - RESERVE)), p1 * (1 - RESERVE)
                if (m + d) * cold - d * once < 1.1 * need + 4:
                    cost += 1e9
                    continue
                used_d = min(d, need / max(double, 1e-9))
                used = max(0.0, need - used_d * double) / max(plain, 1e-9)
                cost += (used_d * (1 - p0 + mean) + used * (1 - p0)) / n + MEETING_COST * hot_share * (used * hot + used_d * 2 * hot) / n
            if best is None or cost < best[0]:
                best = (cost, m, d)
    return best[1], best[2]


def ranks(s: np.ndarray) -> np.ndarray:
    """Place of each hash in the order that all sets take their segments in."""
    return mix64(s ^ np.uint64(0x5851F42D4C957F2D))


def signatures(s: np.ndarray, frequent: np.ndarray, hot_share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, kinds) of a set of hashes; kind 0 was weighed, 1 is a side entry, 2 is of a short set."""
    n = len(s)
    g = band(n)
    u = np.sort(ranks(s))
    warm = _member(u >> np.uint64(24), frequent)
    sigs, kinds = [], []
    for family in (g, g + 1) if largest_partner(n) > 4**g else (g,):
        m, d = allocation(family, hot_share)
        partner = min(largest_partner(n), 4**family)
        need = differences(n, max(n, partner)) + 1
        seg = u >> np.uint64(24) if m >> 32 else (u >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        h = mix64(u + np.uint64(family))
        begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.concatenate([begin, [n]]))
        which = seg[begin]
        total = np.add.reduceat(h, begin)
        cold = ~np.logical_and.reduceat(warm, begin)
        deleting = which < np.uint64(d)
        weight = np.where(cold, np.where(deleting & (size > 1), 2, 1), 0)
        reach = np.cumsum(weight)
        short = reach[-1] < need
        stop = len(begin) if short else int(np.searchsorted(reach, need)) + 1
        kind = np.full(stop, 2) if short else np.where(weight[:stop] > 0, 0, 1)
        salt = mix64(which[:stop] + np.uint64(family << 48))
        sigs.append(mix64(total[:stop] ^ salt))
        kinds.append(kind)
        many = np.flatnonzero(deleting[:stop] & (size[:stop] > 1))
        if len(many):
            count = size[many]
            at = np.repeat(begin[many] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            of = np.repeat(many, count)
            sigs.append(mix64((total[of] - h[at]) ^ salt[of]))
            kinds.append(kind[of])
    return np.concatenate(sigs), np.concatenate(kinds).astype(np.uint8)


def set_node(s: np.ndarray) -> int:
    """The set's number: equal for equal sets."""
    if not len(s):
        return 0
    v = mix64(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s)), len(s)], np.uint64))
    return int(mix64(v[:1] ^ (v[1:2] << np.uint64(1)) ^ v[2:3]).view(np.int64)[0])


def _key():
    return F.xxhash64("doc_id", "text")


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key, n and node of every document."""

    @releasing
    def run(batches):
        for batch in batches:
            got = [(len(s), set_node(s)) for _, s in shingle_sets(texts_of(batch))]
            if got:
                n, node = zip(*got, strict=True)
                yield with_columns(batch, ["doc_id", "key"], ["n", "node"], [pa.array(n, pa.int64()), pa.array(node, pa.int64())])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n long, node long")


def _frequent(docs: DataFrame, shingles: int) -> tuple[np.ndarray, float]:
    """Sorted upper 40 bits of the ranks of frequent shingles, and the part of all shingles that they make up.

    Equal texts of a batch count once.
    """
    parts, limit = max(256, shingles // 1_000_000 + 1), np.uint64(int(HINT_PART * 2**64))
    bounds = np.array([int(HINT_PART * 2**40) * k // parts for k in range(parts)], np.uint64)
    low = np.uint64(2**32 - 1)  # a part is narrower than 32 bits, so these tell its ranks apart

    @releasing
    def spread(batches):
        for batch in batches:
            got = [u[u < limit] >> np.uint64(24) for u in (ranks(s) for _, s in shingle_sets(dict.fromkeys(texts_of(batch))))]
            u = np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)
            cut = np.searchsorted(u, bounds[1:])
            yield pa.record_batch({"p": pa.array(range(parts), pa.int32()), "u": pa.array([x.tobytes() for x in np.split((u & low).astype(np.uint32), cut)], pa.binary())})

    @releasing_group
    def count(key, f):
        u = np.frombuffer(b"".join(f["u"]), np.uint32).astype(np.uint64)
        u, c = np.unique(bounds[key[0]] + ((u - bounds[key[0]]) & low), return_counts=True)
        keep = c > HINT_COUNT
        return pd.DataFrame({"u": [u[keep][np.argsort(-c[keep], kind="stable")][: HINT_MAX // parts].tobytes()], "hot": [int(c[keep].sum())], "every": [int(c.sum())]})

    rows = docs.select("text").mapInArrow(spread, "p int, u binary").groupBy("p").applyInPandas(count, "u binary, hot long, every long").collect()
    table = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["u"], np.uint64) for r in rows)]))
    return table, sum(r["hot"] for r in rows) / max(1, sum(r["every"] for r in rows))


def _member(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(s), bool)
    at = np.minimum(np.searchsorted(table, s), len(table) - 1)
    return table[at] == s


def _entries(docs: DataFrame, frequent, hot_share: float, buckets: int) -> DataFrame:
    """bucket and packed entries (signature, node, kind), one row for each bucket and batch."""

    @releasing
    def run(batches):
        for batch in batches:
            sig, node, kind = [], [], []
            seen: set[int] = set()
            for _, s in shingle_sets(texts_of(batch)):
                v = set_node(s)
                if not len(s) or v in seen:
                    continue
                seen.add(v)
                a, k = signatures(s, frequent.value, hot_share)
                sig.append(a)
                kind.append(k)
                node.append(np.full(len(a), v, np.int64))
            if not sig:
                continue
            sig, node, kind = np.concatenate(sig), np.concatenate(node), np.concatenate(kind)
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, node, kind = bucket[order], node[order], kind[order]
            low = sig[order].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.concatenate([at[1:], [len(bucket)]])
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])])
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate([begin, [len(node)]])).astype(np.uint32)
            lo, hi = np.searchsorted(begin, at), np.searchsorted(begin, end)
            rows = [(int(bucket[a]), low[a:b].tobytes(), node[begin[c:d]].tobytes(), count[c:d].tobytes(), kind[a:b].tobytes()) for a, b, c, d in zip(at, end, lo, hi, strict=True)]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)), names=["bucket", "sig", "node", "count", "kind"])

    return docs.select("text").mapInArrow(run, "bucket int, sig binary, node binary, count binary, kind binary")


@releasing_group
def _meet(key, f):
    """One bucket: pairs to verify (kind 0) and a spanning forest of the clusters (kind 1)."""
    raw = np.zeros((sum(map(len, f["sig"])) // SIG_BYTES, 8), np.uint8)
    raw[:, :SIG_BYTES] = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(-1, SIG_BYTES)
    sig = raw.view(np.uint64)[:, 0]
    node = np.repeat(np.frombuffer(b"".join(f["node"]), np.int64), np.frombuffer(b"".join(f["count"]), np.uint32))
    kind = np.frombuffer(b"".join(f["kind"]), np.uint8)
    order = np.argsort(sig, kind="stable")
    sig, node, kind = sig[order], node[order], kind[order]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    end = np.concatenate([at[1:], [len(sig)]])
    pairs: set[tuple[int, int]] = set()
    forest = Forest()
    for a, b in zip(at[end - at > 1].tolist(), end[end - at > 1].tolist(), strict=True):
        weighed = sorted(set(node[a:b][kind[a:b] == 0].tolist()))
        every = sorted(set(node[a:b].tolist()))
        if len(every) > 1 and weighed:
            if len(weighed) * len(every) <= DIRECT_PAIRS:
                pairs |= {(min(x, y), max(x, y)) for x in weighed for y in every if x != y}
            else:
                for x in every[1:]:
                    forest.join(every[0], x)
        short = sorted(set(node[a:b][kind[a:b] == 2].tolist()))
        for x in short[1:]:
            forest.join(short[0], x)
    rows = [(*p, 0) for p in pairs] + [(*p, 1) for p in forest.edges]
    return pd.DataFrame(rows, columns=["a", "b", "kind"]).astype({"a": "int64", "b": "int64", "kind": "int32"})


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
        return False
    both = int(_member(x, y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def cells(s: np.ndarray) -> np.ndarray:
    """Number of elements in equal parts of the hash range, a power of two of them, about CELL each."""
    k = max(4, (len(s) // CELL).bit_length())
    return np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k).astype(np.uint16)


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    """False only if the histograms prove that the sets differ too much."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x) > len(y):
        x = x[0::2] + x[1::2]
    while len(y) > len(x):
        y = y[0::2] + y[1::2]
    return int(np.abs(x - y).sum()) <= differences(int(x.sum()), int(y.sum()))


@releasing
def _possible(frames):
    for f in frames:
        ok = [_near(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) for x, y in zip(f["ka"], f["kb"], strict=True)]
        yield f.loc[ok, ["a", "b"]]


@releasing
def _verify(frames):
    for f in frames:
        ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(f["sa"], f["sb"], strict=True)]
        yield f.loc[ok, ["a", "b"]]


def _block_links(f: pd.DataFrame) -> pd.DataFrame:
    """Members (role 0) against references (role 1) of one block: a spanning forest of their links."""
    sets = [np.frombuffer(x, np.uint64) for x in f["s"]]
    node, role = f["node"].to_numpy(), f["role"].to_numpy()
    refs = np.flatnonzero(role == 1)
    forest = Forest()
    token = np.concatenate([sets[i] for i in refs])
    owner = np.repeat(np.arange(len(refs)), [len(sets[i]) for i in refs])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    size = np.array([len(sets[i]) for i in refs])
    for i in np.flatnonzero(role == 0):
        s = sets[i]
        lo, hi = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        c = hi - lo
        at = np.repeat(lo - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both = np.bincount(owner[at], minlength=len(refs))
        for k in np.flatnonzero(100 * both >= PERCENT * (len(s) + size - both)):
            if node[i] != node[refs[k]]:
                forest.join(int(node[i]), int(node[refs[k]]))
    return pd.DataFrame(forest.edges, columns=["a", "b"]).astype("int64")


def _salted(rows: DataFrame) -> DataFrame:
    """Adds salt to rows with node and size: clusters of several chunks are dealt to SALTS parts."""
    return rows.withColumn("salt", F.when(F.col("size") > CHUNK, F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS))).otherwise(0).cast("int"))


def _all_salts(clusters: DataFrame) -> DataFrame:
    """One row of every cluster (cid, size, ...) for each of its salts."""
    last = F.when(F.col("size") > CHUNK, SALTS - 1).otherwise(0)
    return clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("size")


def _against(members: DataFrame, refs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of every cluster's members with its references, by blocks that are bounded in sets and in bytes.

    members: cid, node, size and parts (blocks that the cluster's members are dealt to); refs: those that are references.
    Everything by cluster is done on these narrow rows, those of large clusters in parts; sets are joined by node at the end, so a
    large cluster's sets never meet in one task.
    """
    deal = lambda parts, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    # references are dealt to as many blocks as their share of the cluster needs
    counts = refs.groupBy("cid").agg(F.count(F.lit(1)).alias("refs"), F.max("parts").alias("p"), F.max("size").alias("size"))
    blocks = _all_salts(counts.select("cid", "size", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("refs") / F.col("size"))).cast("int").alias("blocks")))
    m = _salted(members).join(blocks, ["cid", "salt"]).withColumn("c", deal("parts", 0)).withColumn("r", every("blocks"))
    q = _salted(refs).join(blocks, ["cid", "salt"]).withColumn("r", deal("blocks", 1)).withColumn("c", every("parts"))
    cols = ["cid", "c", "r", "node"]
    both = m.select(*cols, F.lit(0).alias("role")).unionByName(q.select(*cols, F.lit(1).alias("role")))

    @releasing_group
    def run(key, f):
        return _block_links(f) if f["role"].nunique() == 2 else pd.DataFrame({"a": [], "b": []}).astype("int64")

    return both.join(sets.select("node", "s"), "node").groupBy("cid", "c", "r").applyInPandas(run, "a long, b long")


def _resolve_clusters(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect whatever is connected inside each cluster."""
    label = connected_components(edges)
    sets = stored(sets.select("node", "s").join(label.select("node"), "node"), "cluster-sets")  # those of clusters alone
    label = label.join(sets.select("node", F.length("s").alias("bytes")), "node")
    sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int")
    members = label.drop("bytes").join(sizes, "label").select(F.col("label").alias("cid"), "node", "size", parts.alias("parts"))
    members = stored(members, "members")
    chance = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    first = stored(_against(members, members.filter(chance * F.col("size") < PIVOTS), sets), "links")
    part = connected_components(first)
    placed = stored(members.join(part, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    main = placed.groupBy("cid", "label").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
    main = main.groupBy("cid").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("size").alias("size"))
    rest = _salted(placed).join(_all_salts(main), ["cid", "salt"]).filter("label != main").select(members.columns)
    # stored, as what follows is Python again: one worker for each task is enough then
    return first.union(stored(_against(members, stored(rest, "rest"), sets), "links"))


def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, node of every document; node, label of every node that has links)."""
    docs = docs.select("doc_id", "text")
    rows = stored(document_sets(docs), "sets")
    total = rows.agg(F.sum("n").alias("n")).first()
    spark = docs.sparkSession
    table, share = _frequent(docs, total["n"] or 0)
    frequent = spark.sparkContext.broadcast(table)
    buckets = max(8, (total["n"] or 0) // BUCKET_SHINGLES + 1)
    entries = _entries(docs, frequent, math.ceil(20 * share) / 20, buckets)
    found = stored(entries.groupBy("bucket").applyInPandas(_meet, "a long, b long, kind int"), "meetings")
    frequent.destroy()
    pairs = found.filter("kind = 0").select("a", "b").distinct()
    clusters = found.filter("kind = 1").select("a", "b")
    nodes = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    wanted = stored(rows.groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node"), "wanted")

    @releasing
    def load(batches):
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            keep = [(v, s.tobytes(), cells(s).tobytes()) for v, (_, s) in zip(nodes, shingle_sets(texts_of(batch)), strict=True) if set_node(s) == v]
            if keep:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*keep, strict=True), (pa.int64(), pa.binary(), pa.binary()))), names=["node", "s", "k"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_SETS else wanted
    texts = docs.select(_key().alias("key"), "text").join(few, "key").select("node", "text")
    sets = stored(texts.mapInArrow(load, "node long, s binary, k binary").dropDuplicates(["node"]), "candidates")

    def with_both(pairs: DataFrame, c: str) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(v), F.col(c).alias(f"{c}{v}")) for v in "ab")
        return pairs.join(a, "a").join(b, "b")

    near = stored(with_both(pairs, "k").mapInPandas(_possible, "a long, b long"), "pairs")
    checked = stored(with_both(near, "s").mapInPandas(_verify, "a long, b long"), "links")
    links = checked if clusters.isEmpty() else checked.union(_resolve_clusters(clusters, sets.drop("k")))
    labels = stored(connected_components(links), "labels")
    discard(found, wanted, sets, near, checked)
    return rows, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, labels = link_components(docs)
    placed = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = placed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("first"))
    out = placed.join(stored(first, "first"), "label", "left")  # read back, so that a large component's rows can be split
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least doc_id, and all rows without shingles; columns stay as they are.

    Rows are told apart by id and text: of rows that agree in both, one stays. Of components without any id, and among rows of the
    least id, the least hash stays.
    """
    rows, labels = link_components(docs)
    placed = rows.filter("n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    key = fresh(docs, "key")
    keep = first.select(F.col("m.key").alias(key)).union(rows.filter("n = 0").select("key")).distinct()
    kept = docs.withColumn(key, _key()).join(keep, key, "left_semi")
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.drop(key)

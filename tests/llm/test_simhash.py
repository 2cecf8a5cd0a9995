import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import components, simhash_join
from tests.llm.helpers import words


def brute_fingerprint(text):
    w = words(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass"), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Position of the first member of every position's component."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def components_of(spark, fps):
    rows = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(fps)], "fp long")
    found = components.connected_components(simhash_join.fingerprint_links(rows)).collect()
    label = {r["node"]: r["label"] for r in found}
    return [label.get(v, v) for v in (int(np.uint64(x).view(np.int64)) for x in fps)]


def same_partition(got, want):
    return len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("Ab c déf  x ÀB z,".split(" ")) for _ in range(n)) for n in (1, 2, 3, 4, 5, 40, 700)]
    for t in [None, "", " \t\n\v\f\r", "one", "ONE two", "a\x1cb c d e", "É é E e", "\ud800 x y", "a a a a a a", *texts]:
        assert simhash_join.simhash(t) == brute_fingerprint(t)
    assert simhash_join.simhash("One\tTWO\n three") == simhash_join.simhash("one two three")
    long = " ".join(str(rng.random()) for _ in range(120_000))
    assert simhash_join.simhash(long) == simhash_join.simhash(long.replace(" ", "\n "))


def test_lower_bound_and_cells(spark):
    rng = random.Random(2)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([x ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 9]))) & (2**64 - 1) for x in map(int, a)], np.uint64)
    counts = lambda x: [bin(int(x) >> 2 * k & 3).count("1") for k in range(32)]
    for x, y, d in zip(a[:500], b[:500], np.bitwise_count(simhash_join._sorted_segments(a) ^ simhash_join._sorted_segments(b)), strict=False):
        assert d == sum(abs(p - q) for p, q in zip(counts(x), counts(y), strict=True)) <= bin(int(x) ^ int(y)).count("1")
    assert set(simhash_join._linked(a, b)) == {k for k in range(3000) if bin(int(a[k]) ^ int(b[k])).count("1") <= 3}
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in a[:50]], "fp long").withColumn("own", simhash_join._own_cells(F.col("fp")))
    for r in df.withColumn("up", F.transform("own", simhash_join._cells_above)).collect():
        c = counts(np.int64(r["fp"]).view(np.uint64))
        for half, cell, above in zip((0, 1), r["own"], r["up"], strict=True):
            mine = c[16 * half : 16 * half + 16]
            code = lambda v: sum(n << 2 * k for k, n in enumerate(v)) | half << 32  # noqa: E731, B023
            assert cell == code(mine) and sorted(above) == sorted(code([*mine[:k], mine[k] + 1, *mine[k + 1 :]]) for k in range(16) if mine[k] < 2)


@pytest.mark.parametrize("crowd", [False, True])
def test_links_equal_brute_force(spark, monkeypatch, crowd):
    """Chains of three-bit steps, balls around a centre, lone fingerprints; with crowded cells in tiles as well."""
    rng = random.Random(5)
    if crowd:
        for name, value in {"TILE": 16, "FIRST_TILE": 8, "CROWDED": 4, "BATCH_ROWS": 50, "BATCH_PAIRS": 30}.items():
            monkeypatch.setattr(simhash_join, name, value)
    flip = lambda x, n: x ^ sum(1 << k for k in rng.sample(range(64), n))
    fps = [0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(300))]
    for step in (1, 2, 3, 3, 4):
        fps.append(rng.getrandbits(64))
        fps += [fps[-1] for _ in range(2)]
        for _ in range(12):
            fps.append(flip(fps[-1], step))
    for spread in (2, 3, 4, 5):
        centre = rng.getrandbits(64)
        fps += [flip(centre, rng.randrange(spread + 1)) for _ in range(150)]
    assert same_partition(components_of(spark, fps), brute_groups(fps))


def test_documents(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(900)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    texts = [None, "", " \n", "one", "ONE", "one two"]
    for _ in range(40):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    rows = [(100 - k, t, "x", 0) for k, t in enumerate(texts)] + [(None, "one two", None, None), (None, "no id here", "", 1), (7, texts[-1], "x", 0), (7, texts[-1], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, label int")
    got = simhash_join.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    group = brute_groups(fps)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = [(rows[i][0], f"{fps[i]:016x}", least[group[i]]) for i in range(len(rows))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(set(group)) < len(set(fps))
    assert simhash_join.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_hub(spark, monkeypatch):
    """A hub with very many edges, chains and small stars, with hubs sent to all tasks."""
    monkeypatch.setattr(components, "CROWD", 20)
    rng = random.Random(4)
    edges = [(0, k) for k in range(1000, 1400)] + [(2000 + k, 2001 + k) for k in range(60)] + [(3000, 3000 + k) for k in range(1, 90)] + [(1399, 3089)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a long, b long").repartition(16)
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: 2000 if 2000 <= x <= 2060 else 0 for x in nodes}

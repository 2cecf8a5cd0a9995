import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import components, fingerprints, jaccard_join, lm_scoring, packing, token_files, tokens
from tests.llm.helpers import shingles, words


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] if s else d for i, (d, s) in enumerate(sets)}


def corpus(seed=0):
    """Families of near copies around the threshold, exact copies, a common line, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, docs = text(12), []
    for k in range(60):
        base = text(rng.choice([3, 5, 6, 9, 20, 60, 200, 900]))
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(w) // 25)])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.choice([0.7, 0.76, 0.8, 0.95])))]
            if k % 3 == 0:
                w = line + w
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [*enumerate(docs), (9000, ""), (9001, " \t\n"), (9002, "one"), (9003, "ONE")]


def test_jaccard_join_agrees_with_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    got = jaccard_join.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(t)) for r, (_, t) in zip(sorted(got, key=lambda r: r["doc_id"]), docs, strict=True))
    # one-deletion segments, and clusters in place of pairs, give the same
    monkeypatch.setattr(jaccard_join, "allocation", lambda g, share: (1 << 40, 0) if g < 3 else (4**g // 2, 4**g // 8))
    monkeypatch.setattr(jaccard_join, "DIRECT_PAIRS", 1)
    monkeypatch.setattr(jaccard_join, "HINT_COUNT", 3)
    got = jaccard_join.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_deletion_signatures_meet():
    rng = np.random.default_rng(0)
    old = jaccard_join.allocation
    jaccard_join.allocation = lambda g, share: (4**g // 2, 4**g // 2)
    try:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
            b = np.unique(np.concatenate([a[28:], rng.integers(0, 2**63, 20).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                x, y = (jaccard_join.signatures(s, np.zeros(0, np.uint64)) for s in (a, b))
                assert np.intersect1d(x[0][x[1] != 1], y[0]).size
    finally:
        jaccard_join.allocation = old


def test_jaccard_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (7, None), (5, "a b c d e f"), (8, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()))
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]
    kept = jaccard_join.keep_first(df.withColumn("node", df.doc_id)).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 7, 8]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    a, b = "a b c d e f g", "r s t u v w"
    kept = jaccard_join.keep_first(spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3)], "doc_id long, text string, key int"))
    assert sorted(map(tuple, kept.collect())) == [(3, a, 1), (5, b, 3)] and kept.columns == ["doc_id", "text", "key"]


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (50, 50)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}


def test_a_group_in_many_tasks_has_its_edges_once(spark, monkeypatch):
    """A group of which every task holds edges, beside a path that needs more rounds: edges do not grow with the tasks."""
    group = spark.range(0, 16 * 300, 1, 16).selectExpr("id % 300 + 1000 AS a", "999L AS b")
    path = spark.range(0, 40, 1, 8).selectExpr("id AS a", "id + 1 AS b")
    seen, old = [], components._contracted

    def counted(edges):
        out = old(edges)
        seen.append(out.count())
        return out

    monkeypatch.setattr(components, "_contracted", counted)
    got = {r["node"]: r["label"] for r in components.connected_components(group.union(path)).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 999 for k in range(999, 1300)}
    assert len(seen) > 1 and max(seen) <= 300 + 40


def test_scores_agree_with_brute_force(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("AaBbCcdefgh") for _ in range(rng.randint(0, 60)))) for k in range(200)] + [(900, None), (901, "")]
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    toks = {d: [*words(t), None] for d, t in docs}
    train = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 10}
    c = Counter(w for d in train for w in toks[d])
    n, v = sum(c.values()), len(c)
    for d, t in toks.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = got[d]
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in t) and r["held_out"] == (d not in train) and r["score"] < 0


def brute_model(docs, held_block):
    """Scores by dictionaries of n-grams: total counts, and weights from the deleted block alone."""
    toks = [[*words(t), None] for _, t in docs]
    train = [zlib.crc32(str(d).encode()) % 10 > 0 for d, _ in docs]
    grams = lambda t: [(k, *(["<"] * 2 + t)[i + 3 - k : i + 3]) for i in range(len(t)) for k in (1, 2, 3)]

    def count(which):
        c = Counter(g for t, ok in zip(toks, which, strict=True) if ok for g in grams(t))
        return c, sum(which)

    return toks, train, grams, count(train), count([ok and not h for ok, h in zip(train, held_block, strict=True)])


def test_estimates_and_held_out_counts_agree_with_dictionaries(spark, monkeypatch):
    """All estimates before they are mixed: from all training documents, and without the deleted block."""
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choice(["red", "blue", "green", "the", "a"]) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    seen = {}

    def keep(cells):
        seen["cells"] = cells
        return [np.concatenate([[0.0], np.full(lm_scoring.LEVELS - 1, w)]) for w in (0.5, 0.25, 0.5)]

    monkeypatch.setattr(lm_scoring, "mixture_weights", keep)
    monkeypatch.setattr(lm_scoring, "GROUP_CHARS", 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for fan in (10, 2):
        monkeypatch.setattr(lm_scoring, "FAN_BITS", fan)
        got = {r["doc_id"]: r for r in lm_scoring.score_texts(df).collect()}
        chars = sum(len(t) for _, t in docs) + len(docs)
        groups = -(-chars // 400)
        assert len(lm_scoring.level_bits(groups)) == (1 if fan == 10 else 2 if groups <= 16 else 3)
        key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))
        group = {r["doc_id"]: r["g"] for r in df.select("doc_id", key.alias("g")).collect()}
        toks, train, grams, (full, n_docs), (kept, kept_docs) = brute_model(docs, [group[d] % 10 == 1 for d, _ in docs])
        tokens = sum(c for g, c in full.items() if g[0] == 1)
        distinct = sum(g[0] == 1 for g in full)

        def context(c, n, t, i, k):
            g = (["<"] * 2 + t)[i + 3 - k : i + 2]
            return n if all(x == "<" for x in g) else c[(k - 1, *g)]

        held_tokens = 0
        for (d, _), t, ok in zip(docs, toks, train, strict=True):
            score = 0.0
            for i in range(len(t)):
                g3 = grams(t)[3 * i : 3 * i + 3]
                base = (full[g3[0]] + 0.1) / (tokens + 0.1 * (distinct + 1))
                p = 0.5 * full[g3[0]] / tokens + 0.5 * base
                for k, w in ((2, 0.25), (3, 0.5)):
                    c = context(full, n_docs, t, i, k)
                    p = w * full[g3[k - 1]] / c + (1 - w) * p if c else p
                score += math.log10(p)
            assert abs(score - got[d]["score"]) < 1e-6 * max(1, abs(score))
            held_tokens += len(t) * (ok and group[d] % 10 == 1)
        assert seen["cells"]["n"].sum() == held_tokens > 0
        # the mean ratio of the kept word estimate to the smoothed one, over the deleted block
        kept_tokens = sum(c for g, c in kept.items() if g[0] == 1)
        want = 0.0
        for (d, _), t, ok in zip(docs, toks, train, strict=True):
            if ok and group[d] % 10 == 1:
                want += sum((kept[(1, w)] / kept_tokens) / ((kept[(1, w)] + 0.1) / (kept_tokens + 0.1 * (distinct + 1))) for w in t)
        assert abs(seen["cells"]["r2"].sum() - want) < 1e-6 * want


def test_mixed_estimates_are_a_distribution():
    """For one context, the mixed probabilities of all known words and the unknown one add up to 1."""
    rng = np.random.default_rng(0)
    v, n = 50, 400
    one = rng.multinomial(n, rng.dirichlet(np.ones(v)))
    base = np.append(one + 0.1, 0.1) / (n + 0.1 * (v + 1))
    for context in (0, 3):
        orders = [(np.full(v + 1, lm_scoring._level(np.array([context]))[0]), np.append(rng.multinomial(context, np.ones(v) / v), 0) / max(context, 1)) for _ in range(2)]
        orders.append((np.ones(v + 1, int), np.append(one, 0) / n))
        weights = [np.concatenate([[0.0], rng.random(lm_scoring.LEVELS - 1)]) for _ in range(3)]
        assert abs(lm_scoring.interpolate(base, orders, weights).sum() - 1) < 1e-12


def test_mixture_weights_prefer_what_predicts():
    """At level 3 the trigram predicts well, at level 5 never; levels without data take the order's mean; level 0 gets nothing."""
    code = lambda l3, l2, q: (((l3 * 32 + q) * lm_scoring.LEVELS + l2) * 32 + 5) * 32 + 5
    cells = pd.DataFrame({"cell": [code(3, 2, 8), code(5, 2, 0)], "n": [900.0, 100.0], "r0": [900.0 * 8, 0.0], "r1": [900.0, 100.0], "r2": [900.0, 100.0]})
    w = lm_scoring.mixture_weights(cells)
    assert w[0][3] > 0.9 and w[0][5] < 0.1 and 0.5 < w[0][7] < 0.95 and w[0][0] == w[1][0] == 0


def test_scores_of_empty_tables(spark):
    assert lm_scoring.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700))
def test_shards_round_trip(ids):
    ids = np.array(ids, np.uint32)
    cut = len(ids) // 3
    shard = token_files.write_shard(np.array([7, -1]), np.array([cut, len(ids) - cut]), ids)
    doc_ids, lengths, back = token_files.read_shard(shard)
    assert doc_ids.tolist() == [7, -1] and lengths.tolist() == [cut, len(ids) - cut] and (back == ids).all()
    for a, b in ((0, 1), (cut, len(ids)), (cut // 2, cut), (130, 131), (5, 5)):
        assert (token_files.read_ids(shard, a, b) == ids[a:b]).all()


def test_an_id_with_most_rows_gets_several_buckets(spark, monkeypatch):
    from quadrille.llm.common import ordered_buckets

    rows = [(5 if k % 3 else k, f"t{k}") for k in range(3000)] + [(None, f"n{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    n, bucket = ordered_buckets(df, "doc_id", F.col("tie"), 100, 32**3)
    got = df.withColumn("b", bucket).groupBy("b").count().collect()
    assert n == 36 and max(r["count"] for r in got) < 260
    keyed = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["tie"], r["b"]) for r in df.withColumn("b", bucket).collect()))
    assert [b for *_, b in keyed] == sorted(b for *_, b in keyed)
    monkeypatch.setattr(token_files, "ROWS_PER_BUCKET", 100)
    back = token_files.read_token_table(token_files.write_token_table(df)).toPandas()
    ids = {t: len(x) for (_, t), x in zip(rows, _library_ids([t for _, t in rows]), strict=True)}
    assert len(back) == len(rows) and back["n_tokens"].sum() == sum(ids.values()) and sorted(back["start"]) == sorted(np.cumsum([0, *back.sort_values("start")["n_tokens"]])[:-1])


def test_ids_agree_with_the_library():
    enc, rng = tokens.Encoder(), random.Random(0)
    chars = [*map(chr, range(256)), *"’—ñ“0Ⅷ٣中文😀\u3000\u200b", *[" ", "\n", "'s", "'ll", "  ", "<|endoftext|>"] * 6]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + [None, ""]
    ids, bounds = enc.encode(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*enc.tok.encode(t or "", add_special_tokens=False).ids, 2]


def _library_ids(texts):
    enc = tokens.encoder(None)
    return [[*e.ids, 2] for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_table(spark):
    docs = [(5, "hello world"), (1, None), (9, "x " * 3000), (-4, ""), (None, "null id")]
    got = token_files.read_token_table(token_files.write_token_table(spark.createDataFrame(docs, "doc_id long, text string"), shard_ids=100)).toPandas()
    order = sorted(docs, key=lambda d: -(10**9) if d[0] is None else d[0])
    ids = _library_ids([t for _, t in order])
    starts = np.cumsum([0, *map(len, ids)])
    for (d, _), x, s in zip(order, ids, starts, strict=False):
        r = got[got["doc_id"].isna()] if d is None else got[got["doc_id"] == d]
        assert (r["start"].item(), r["n_tokens"].item(), r["ids_crc32"].item()) == (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_table(token_files.write_token_table(empty)).count() == 0


def test_lower_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 1025, rng.integers(1, 300))
        bins = packing.best_fit_decreasing(sizes)[2]
        assert packing.lower_bound(sizes) <= len(bins) and bins.sum() == sizes.sum() and bins.max() <= 1024
    assert packing.lower_bound(np.full(10, 513)) == 10 and packing.lower_bound(np.full(9, 342)) == 5


def test_packing(spark):
    rng = random.Random(1)
    docs = [(k, "word " * rng.choice([0, 3, 100, 700, 1023, 1024, 3000])) for k in range(400)] + [(7, "again"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.token_pieces(df)
    got = packing.pack(pieces, partition_pieces=50).toPandas()
    total = sum(map(len, _library_ids([t for _, t in docs])))
    assert got["length"].sum() == total and got["length"].max() == 1024
    g = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (g["length"].sum() <= 1024).all() and (g["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    # the certified bound for all documents together, without partitions: nothing can take fewer sequences
    sizes = np.array([len(x) for x in _library_ids([t for _, t in docs])])
    rest = sizes[sizes % 1024 > 0] % 1024
    assert got["sequence_id"].nunique() == (sizes // 1024).sum() + packing.lower_bound(rest)
    one = got[(got["doc_id"] == 5)].sort_values("piece")
    assert (one["length"].iloc[1:] == 1024).all() and (one["start"] == one["length"].cumsum() - one["length"]).all()
    assert packing.pack_documents(df.limit(0)).count() == 0


def brute_sketch(text, bits=fingerprints.FRACTION_BITS):
    signed = lambda x: x - (x >> 63 << 64)

    def chain(numbers):
        h = 42
        for x in numbers:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return signed(h)

    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.split("[ \\t\\n\\x0b\\f\\r]+", text.lower()) if x]
    hashes = {chain(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {chain(w)} if w else set()
    return {h for h in hashes if h < -(1 << 63) + (1 << 64 - bits)}


def test_sketches_merge_and_contain(spark):
    """A part of a text is contained in it however short; the sketch of a union is the union of sketches."""
    rng = random.Random(5)
    long = [f"q{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(1, "long", " ".join(long)), (1, "part", " ".join(long[500:900])), (2, "part", " ".join(long[:400])), (2, "other", " ".join(f"z{k}" for k in range(300))), (3, "none", "")]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "g int, name string, text string"), "text", "sketch").cache()
    got = {r["g"]: set(r["sketch"]) for r in fingerprints.merge_sketches(df, "g").collect()}
    assert got == {g: set().union(*(brute_sketch(t) for h, _, t in rows if h == g)) for g in (1, 2, 3)}
    a, b = (df.filter(f"name = '{n}' AND g = {g}").select(F.col("sketch").alias(n)) for n, g in (("long", 1), ("part", 1)))
    both = a.crossJoin(b).select(fingerprints.containment(F.col("part"), F.col("long"), F.lit(False)).alias("c"), fingerprints.likeness(F.col("part"), F.col("long"), F.lit(False)).alias("l")).first()
    assert both["c"] == 1 and both["l"] < 0.05


def test_fingerprints_of_rows_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 20)
    rows = [(9, f"text number {k} of many that share one id") for k in range(300)] + [(k, f"row {k}") for k in (3, 40)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 302 and sum(r["doc_id"] == 9 for r in got) == 300


def test_fingerprints(spark):
    rng = random.Random(8)
    docs = [(k * 3 - 50, " ".join(rng.choice(["red", "blue", "Green", "x", "y", "z", "w"]) for _ in range(rng.choice([0, 1, 4, 5, 30, 400])))) for k in range(90)]
    docs += [(1000, docs[5][1]), (1001, docs[5][1]), (2000, None), (2001, "é" * 7)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in docs]
    for k, (d, _) in enumerate(docs):
        t, nxt = texts[k], texts[(k + 1) % len(docs)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1 if t == nxt else True)
    assert got[1000]["fingerprint"] == got[1001]["fingerprint"] and got[2000]["fingerprint"] == ""
    long = " ".join(f"q{k}" for k in range(4000))
    half = " ".join(f"q{k}" for k in range(2000))
    r = fingerprints.fingerprint_edits(spark.createDataFrame([(1, long), (2, half)], "doc_id long, text string")).collect()
    near = next(x["near_next"] for x in r if x["doc_id"] == 1)
    assert abs(near - 0.5) < 0.06
    # sketches by the hash's own library; likeness and containment from sets
    sets = [brute_sketch(t) for t in texts]
    for k, (d, _) in enumerate(docs):
        t, nxt = texts[k], texts[(k + 1) % len(docs)]
        e = brute_sketch(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])
        assert got[d]["fingerprint"] == "".join(f"{h & (2**64 - 1):016x}" if h < 0 else f"{h:x}" for h in sorted(sets[k]))
        if sets[k] | e:
            assert abs(got[d]["near_edited"] - len(sets[k] & e) / len(sets[k] | e)) < 1e-12
        if sets[k] | sets[(k + 1) % len(docs)]:
            assert abs(got[d]["near_next"] - len(sets[k] & sets[(k + 1) % len(docs)]) / len(sets[k] | sets[(k + 1) % len(docs)])) < 1e-12
        if sets[k]:
            assert abs(got[d]["kept_in_edited"] - len(sets[k] & e) / len(sets[k])) < 1e-12
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_learned(sample, texts):
    """Which texts are like the sample's languages, by sets of 4-grams of their words with end marks."""
    low = lambda c: c.lower() if len(c.lower()) == 1 else c

    def found(text):
        out, word = [], ""
        for c in (text or "") + " ":
            if c.isalpha():
                word += low(c)
            elif word:
                out.append(word)
                word = ""
        return out

    def grams(word):
        w = f"<{word}>"
        return [w[i : i + 4] for i in range(max(1, len(w) - 3))]

    seen = {}
    for lang, text in sample:
        seen.setdefault(lang, set()).update(g for w in found(text) for g in grams(w))
    out = []
    for text in texts:
        ws = found(text)
        share = [max(sum(g in s for g in grams(w)) for s in seen.values()) / len(grams(w)) for w in ws]
        letters = sum(map(len, ws))
        known = sum(len(w) for w, x in zip(ws, share, strict=True) if x >= 0.75)
        weighed = sum(len(w) * x for w, x in zip(ws, share, strict=True))
        out.append(letters > 0 and (weighed >= letters / 3 - 1e-6 if letters < 40 else known >= 0.5 * letters - 1e-6))
    return out


def check_packed(rows, texts):
    """Pieces carry all ids of all documents, sequences are gapless and hold 1024 ids at most."""
    ids = dict(zip(texts, _library_ids(list(texts.values())), strict=True))
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert max(at.values()) <= 1024 and sum(at.values()) == sum(map(len, ids.values()))
    return len(at)


def test_pipeline_stages(spark):
    import corpus_pipeline

    from quadrille.llm import language_id

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).persist()
        if name == "pack":
            sequences = check_packed(out.collect(), before)
            sizes = np.array([len(x) for x in _library_ids(list(before.values()))])
            rest = sizes[sizes % 1024 > 0] % 1024
            assert sequences <= 1.02 * ((sizes // 1024).sum() + packing.lower_bound(rest))
            continue
        assert out.schema.simpleString() == docs.schema.simpleString()
        before = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            sample = [(r["lang"], r["text"]) for r in language_id.sample_labelled(docs).collect()]
            assert set(before) == {k for (k, t), ok in zip(start.items(), brute_learned(sample, start.values()), strict=True) if ok}
        if name == "near_duplicates":
            want = brute_components(list(held.items()))
            assert set(before) == {k for k, v in want.items() if k == v}
        if name == "decontaminate":
            leaks = {k for k, t in held.items() if any(q and len(q & shingles(t)) >= 0.75 * len(q) for q in items)}
            assert set(before) == set(held) - leaks
        if name == "redact":
            assert set(before) == set(held) and all("[REDACTED]" in t for k, t in before.items() if t != start[k])
        held, docs = before, out

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quadrille.llm import oracles, queries, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: best[w] if w in best and n[best[w]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    letters = "abcdeéÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 7, 8, 11, 12]))) for _ in range(60)]
    words = base[:]
    for _ in range(300):
        w = rng.choice(words)
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        words.append(w[:k] + ("" if kind == 0 else rng.choice(letters) + (w[k] if kind == 1 else "")) + w[k + 1 :])
    weights = [1 + rng.randrange(30) ** 2 for _ in words]
    return [(k if k % 9 else None, " ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(words, weights, k=rng.randrange(120)))) for k in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many shards, and segments that are dealt to several of them
        for name, value in {"SHARD_WORDS": 4, "GATHERED": 20, "TABLE_BYTES": 3}.items():
            monkeypatch.setattr(spelling, name, value)
    rows = [*corpus(), (5, None), (6, ""), (7, "12 34"), (8, "abcde" * 40), (8, "abcde" * 40), (8, "abcde" * 40), (9, "ÀBCDEĀàbcde ÀBcde\ud800Àbcde")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = brute_groups(brute_counts(rows))
    got = spelling.spelling_groups(docs).collect()
    assert len(want) > 100 and any(w[1] and w[1] != w[2] for w in want) and any(w[4] > 2 for w in want)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert spelling.spelling_groups(docs.limit(0)).collect() == []


def test_long_run_and_many_ids():
    """One run of a megabyte, and crc32 of ids of any length."""
    rows = [(k, f"hello{'x' * (k % 90)} Ünïcode word {'y' * 1_000_000 if k == 4 else ''}") for k in [*range(300), 10**18, -5]]
    got = Counter()
    for k in range(0, len(rows), 50):
        part = rows[k : k + 50]
        spelling._count_piece([t.encode() for _, t in part], [str(i) for i, _ in part], got)
    assert {w.decode(): n for w, n in got.items() if n >= 3} == brute_counts(rows)


def test_chain_of_forms(spark):
    n = {"abcdefgh": 3, "abcdefgi": 6, "abcdefii": 12, "abcdeiii": 24, "abcdiiii": 48, "abciiiii": 96, "zzzzz": 7, "zzzzy": 13}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    near = {r["word"]: r for r in spelling.near_words(words).collect()}
    assert near["zzzzz"]["best"] == "zzzzy" and near["abcdefgi"]["n_near"] == 2 and near["abcdefgi"]["best"] == "abcdefii"
    links = spark.createDataFrame([(a, b) for a, b in zip([*n][:5], [*n][1:6], strict=True)], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"abciiiii"}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op11_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({oracles.ORACLE_SQL['op11_spelling_variants']})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 300

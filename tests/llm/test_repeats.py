"""Very many equal rows: one row with a number inside, each with its own score outside."""

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quadrille.llm import lm_scoring
from tests.llm.helpers import words


def test_equal_rows_are_one_row_in_a_group(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_CHARS", 40_000)
    same = "the same licence text again and again " * 3
    rows = [(None, same)] * 4000 + [(5, "a b")] * 700 + [(k, f"text number {k} a b {'c ' * (k % 5)}") for k in range(60)] + [(None, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = [len(lm_scoring.Group([r["docs"]], 4).ids) for r in lm_scoring._packed(docs, 20).collect()]
    assert sum(sizes) < 300
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*words(t), ""]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = c.total(), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    got = lm_scoring.score_texts(docs).groupBy("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("s")).agg(F.count(F.lit(1)).alias("k"), F.countDistinct(F.round("score", 6)).alias("scores")).collect()
    want = Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(score(t), 5)) for i, t in rows)
    assert {(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["s"], 5)): r["k"] for r in got} == dict(want)
    assert all(r["scores"] == 1 for r in got)

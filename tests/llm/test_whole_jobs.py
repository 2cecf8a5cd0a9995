import random

from quadrille.llm import decontamination, language_id
from tests.llm.helpers import shingles


def test_short_items_in_long_texts_are_all_found():
    """Benchmarks of short questions: the sketch alone missed about an eighth of the 5-word ones."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(words(rng.choice([5, 5, 6, 7, 8, 12, 20, 21]))) for _ in range(600)]
    texts = []
    for item in items:
        w = words(1500)
        for x in (item, rng.choice(items)):
            at, cut = rng.randrange(len(w)), x.split()
            w[at:at] = cut[: len(cut) - rng.choice([0, 0, 1, 2])]
        texts.append(" ".join(w))
    have, need = [shingles(t) for t in texts], [shingles(t) for t in items]
    by: dict[tuple, set] = {}
    for i, q in enumerate(need):
        for x in q:
            by.setdefault(x, set()).add(i)
    want = set()
    for t, s in enumerate(have):
        want |= {(t, i, len(need[i] & s)) for i in set().union(*(by.get(x, set()) for x in s)) if len(need[i] & s) >= 0.75 * len(need[i])}
    got = decontamination.Index(list(range(len(items))), items).search(texts)
    assert set(got) == want and len(got) == len(want) > 600


def test_texts_of_unlearned_languages_go(spark):
    """Whatever the number of languages, texts in another one and letter noise go; short and mixed ones stay."""
    rng = random.Random(7)
    stems = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(60)] for k in range(7)}
    say = lambda k, n: " ".join(rng.choice(stems[k]) + rng.choice(stems[k])[:2] for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    for languages in (1, 2, 6):
        model = language_id.train([(f"l{k}", say(k, 80)) for k in range(languages) for _ in range(60)])
        good = [say(k, n) for k in range(languages) for n in (1, 2, 30, 400)] + [" ".join(say(k, 40) for k in range(languages))]
        bad = [say(6, n) for n in (2, 30, 400)] + [noise(n) for n in (2, 30, 400)] + ["слово и дело " * n for n in (1, 40)] + ["", "12 ?!"]
        df = spark.createDataFrame([*((k, t) for k, t in enumerate(good)), *((-1 - k, t) for k, t in enumerate(bad))], "doc_id long, text string")
        assert {r["doc_id"] for r in language_id.keep_identified(df, model).collect()} == set(range(len(good)))


def test_recall_of_every_size():
    """Items of every size class in long texts, whole and with a fifth of their shingles missing."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(20_000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 21, 30, 70, 150, 300, 600):
        items, texts = [" ".join(words(n)) for _ in range(50)], []
        for k, item in enumerate(items):
            w = item.split()
            if n >= 24 and k % 2:
                w = w[: int((n - 4) * 0.8) + 4]
            base = words(1500) if n >= 5 else []
            at = rng.randrange(len(base) + 1)
            base[at:at] = w
            texts.append(" ".join(base))
        found = {(t, i) for t, i, _ in decontamination.Index(list(range(50)), items).search(texts)}
        need = [(k, k) for k in range(50) if len(shingles(items[k]) & shingles(texts[k])) >= 0.75 * len(shingles(items[k]))]
        assert len(need) >= 45 and found >= set(need), n

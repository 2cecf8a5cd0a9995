import hashlib
import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pytest

from quadrille.llm import automata, decontamination, html_extract, language_id, secrets, url_filters
from quadrille.llm.common import shingle_sets
from tests.llm.helpers import shingles

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [(re.compile(ASSIGN, re.I | re.A), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
EDGE_DOCS = [(1, None, "x"), (2, "", None), (3, "a " * 30_000, "y"), (3, "a " * 30_000, "y"), (None, "Token: abcdefg é", "z")]


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n)


def test_automaton_agrees_with_regex_module():
    rng = random.Random(5)
    for pattern in ("a+b?c", "(ab|ba){2,}", "[^a]{1,2}c*", "x(y|z)*x", "a{0,3}b"):
        dfa, ref = automata.Dfa([(pattern, False)], anchored=True), re.compile(pattern)
        for _ in range(200):
            s = "".join(rng.choice("abcxyz") for _ in range(rng.randint(0, 12)))
            longest = [max((j for j in range(i, len(s) + 1) if ref.fullmatch(s, i, j)), default=-1) for i in range(len(s))]
            back = automata.Dfa([(pattern, False)], anchored=False, backwards=True).events(np.frombuffer(s[::-1].encode(), np.uint8))[0]
            assert sorted(len(s) - back) == [i for i, j in enumerate(longest) if j > i], (pattern, s)
            assert [dfa.longest(s.encode(), i, 1).get(0, (-1,))[0] for i in range(len(s))] == [j if j > i else -1 for i, j in enumerate(longest)], (pattern, s)


def test_scans_of_long_texts_take_linear_time():
    """Repeated beginnings of a rule, with and without its end, and single lanes without a border."""
    scanner = secrets.Scanner()
    for text in ("eyJ" * 300_000, "eyJ" * 300_000 + ".eyJabc.abcdefgh", "a" * 500_000, "token=" * 100_000, "AKIA" * 200_000):
        begin = time.perf_counter()
        got = scanner.spans([text])[0]
        assert time.perf_counter() - begin < 20
        assert [s for s in got if s[1] < 3] == brute_spans(text)


def test_secret_spans_agree_with_regexes():
    rng = random.Random(1)
    bits = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "abc123", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "é", "\n", "deadbeef" * 4, "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    got = secrets.Scanner().spans(texts)
    for text, spans in zip(texts, got, strict=True):
        assert [s for s in spans if s[1] < 3] == brute_spans(text), text


def test_more_kinds_and_redaction(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefghijk"
    rows = [*EDGE_DOCS, (4, f"see {jwt} and -----BEGIN RSA PRIVATE KEY----- ok", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[1]["spans"] == ""
    assert out[None]["spans"] == "assign:0:14"
    assert [s.split(":")[0] for s in out[4]["spans"].split(",")] == ["jwt", "pem"]
    red = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert red[4]["text"] == "see [REDACTED] and [REDACTED] ok" and red[None]["spans"] == "z" and red[2]["text"] == ""
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([3, 8, 20, 40, 70, 200]))) for k in range(40)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for k in range(300):
        w = text(rng.choice([4, 50, 300, 3000])).split()
        if k % 3 == 0:
            cut = items[rng.randrange(40)][1].split()
            cut = cut[: max(1, int(len(cut) * rng.choice([1, 1, 0.85, 0.6])))]
            at = rng.randint(0, len(w))
            w[at:at] = cut
        docs.append((k, " ".join(w), "c"))
    docs += [(900, None, "c"), (901, "", "c"), (902, "One two", "c"), (903, "one two three", "c")]
    want = set()
    for d, t, _ in docs:
        have = shingles(t)
        for i, q in items:
            need = shingles(q)
            if need and len(need & have) >= 0.75 * len(need):
                want.add((d, i, len(need), len(need & have)))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(df, it).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got} == want and len(want) > 30
    kept = {r["doc_id"] for r in decontamination.remove_leaks(df, it).collect()}
    assert kept == {d for d, *_ in docs} - {w[0] for w in want}
    assert decontamination.find_leaks(df, it.limit(0)).count() == 0
    assert decontamination.remove_leaks(df.limit(0), it).columns == df.columns


def test_shingle_sets_have_the_right_sizes():
    texts = ["", None, "a", "A b", "a b", "a b c d e", "a b c d e f a b c d e", " x\ty\nz  w v u "]
    got = [s for _, s in shingle_sets(texts)]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[3] == got[4]).all()


def _chain_sums(scores, trans):
    """Sum of exp(score) over all label sequences, by label of each word and by pair of neighbours."""
    n, K = scores.shape
    by_word, by_pair = np.zeros((n, K)), np.zeros((K, K))
    for y in itertools.product(range(K), repeat=n):
        v = np.exp(sum(scores[i, k] for i, k in enumerate(y)) + sum(trans[p, q] for p, q in itertools.pairwise(y)))
        by_word[range(n), y] += v
        for p, q in itertools.pairwise(y):
            by_pair[p, q] += v
    return by_word, by_pair


def test_chain_marginals_and_transitions_agree_with_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    scores, trans, first = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), np.array([0, 4, 4, 5, 12])
    for block in (48, 3):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got, joint = language_id.forward_backward(scores, first, trans)
        want = np.zeros((3, 3))
        for a, b in ((0, 4), (4, 5), (5, 12)):
            by_word, by_pair = _chain_sums(scores[a:b], trans)
            z = by_word[0].sum()
            assert np.allclose(by_word / z, got[a:b])
            want += by_pair / z
        assert np.allclose(joint, want)


def test_gradient_agrees_with_finite_differences():
    """Gold minus expected counts is the slope of the log-likelihood, for transitions and for words' scores."""
    rng = np.random.default_rng(3)
    scores, trans, first = rng.normal(size=(11, 3)), rng.normal(size=(3, 3)), np.array([0, 6, 11])
    y = rng.integers(0, 3, 11)

    def likelihood(scores, trans):
        total = 0.0
        for a, b in itertools.pairwise(first):
            gold = scores[range(a, b), y[a:b]].sum() + sum(trans[p, q] for p, q in itertools.pairwise(y[a:b]))
            total += gold - np.log(_chain_sums(scores[a:b], trans)[0][0].sum())
        return total

    p, joint = language_id.forward_backward(scores, first, trans)
    pairs = np.zeros((3, 3))
    for a, b in itertools.pairwise(first):
        for u, v in itertools.pairwise(y[a:b]):
            pairs[u, v] += 1
    for x, grad in ((trans, pairs - joint), (scores, np.eye(3)[y] - p)):
        for at in np.ndindex(x.shape):
            old, h = x[at], 1e-5
            x[at] = old + h
            up = likelihood(scores, trans)
            x[at] = old - h
            down = likelihood(scores, trans)
            x[at] = old
            assert abs((up - down) / (2 * h) - grad[at]) < 1e-6


def test_words_of_switching_texts(spark):
    """Words of texts that switch between languages get their own labels, with places in code points."""
    rng = random.Random(11)
    stems = [["".join(rng.choice(abc) for _ in range(4)) for _ in range(80)] for abc in ("abcdefghi", "defghijkl", "abcjklmno")]
    say = lambda k, n: [rng.choice(stems[k]) + rng.choice(["a", "en", "o"]) for _ in range(n)]
    model = language_id.train([(f"l{k}", " ".join(say(k, 60))) for k in range(3) for _ in range(60)])
    texts, gold = [], []
    for _ in range(40):
        runs = [(k, say(k, rng.randint(4, 12))) for k in rng.sample(range(3), 3)]
        texts.append("é1 " + " ".join(w for _, ws in runs for w in ws))
        gold.append([k for k, ws in runs for _ in ws])
    rows = [(None if i == 0 else 2**60 + i, t) for i, t in enumerate(texts)] + [(5, None), (6, "12 !")]
    got = language_id.label_words(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    right = total = 0
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r["doc_id"] == rows[i][0]), key=lambda r: r["word"])[1:]
        assert [t[r["begin"] : r["end"]] for r in mine] == t.split()[1:] and all(0 < r["p"] <= 1.000001 for r in mine)
        right += sum(r["lang"] == f"l{k}" for r, k in zip(mine, gold[i], strict=True))
        total += len(mine)
    assert right > 0.95 * total and not [r for r in got if r["doc_id"] in (5, 6)]


def test_long_chains_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    scores, trans, first = rng.normal(size=(500, 4)) * 5, rng.normal(size=(4, 4)), np.array([0, 3, 400, 500])
    a = language_id.marginals(scores, first, trans)
    monkeypatch.setattr(language_id, "BLOCK", 10_000)
    assert np.allclose(a, language_id.marginals(scores, first, trans))


def test_language_of_texts(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(4)) for _ in range(40)), lang) for k in range(120) for lang in ("aa" if k % 2 else "bb",)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", None), (902, "abcd " * 4000 + "vwxy " * 1000, None)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["score"] == 0
    assert got[902]["lang_pred"] == "aa" and 0.7 < got[902]["score"] < 0.9
    assert {r["doc_id"] for r in language_id.keep_identified(df, model).collect()} == {k for k, *_ in rows} | {902}
    short = spark.createDataFrame([(1, "abc."), (2, "abcd bcde vwxy wxyz"), (3, "?!")], "doc_id long, text string")
    assert {r["doc_id"] for r in language_id.keep_identified(short, model).collect()} >= {1}
    assert 3 not in {r["doc_id"] for r in language_id.keep_identified(short, model).collect()}
    empty = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, empty).collect()} == {"und"}


def test_html_of_templates_and_odd_pages():
    model = html_extract.train(html_extract.labelled_pages())
    wrong = total = 0
    for nodes, feats in html_extract.labelled_pages(60, seed=77):
        content, _ = model.infer(nodes, feats)
        blocks = [(v.gold, p >= 0.5) for v, p in zip(nodes, content, strict=True) if v.blocks]
        total += len(blocks)
        wrong += sum(bool(a) != b for a, b in blocks)
    assert wrong <= 0.03 * total
    assert model.extract(None) == model.extract("") == model.extract("<!-- x") == ""
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>A &amp; b</h1><p>one\n two <b>three</b><br><p>four &lt;x&gt;<script>var p='</p>'</script></article><footer>&copy; f</footer>"
    assert model.extract(page) == "A & b\n\none two three\n\nfour <x>"


def test_html_off_the_templates():
    model = html_extract.train(html_extract.labelled_pages())
    p = "This is a long paragraph of the article with quite a few words in it, as they have, and it goes on for a while."
    pages = {
        f"<body><article><h1>T</h1><p>{p}<script src=http://cdn.x/>var a=1;</script> end.</p></article>": f"T\n\n{p} end.",
        f'<body><article><p>first words<p title="unclosed>second {p}</p></article>': f"first words\n\nsecond {p}",
        f'<div class="wrapper"><div class="post"><h1>Ti</h1><p>{p}</p><p>{p}</p><div class="comments"><p>nice post</p><p>me too, I like it</p></div></div></div>': f"Ti\n\n{p}\n\n{p}",
        f"<html><body><h1>Title</h1>{p}<br><br>{p}<footer>copyright me</footer></body></html>": f"Title\n\n{p} {p}",
        f"<body><div id=nav><a href=x>Home</a> <a href=y>News</a></div><div id=c12><div>{p}</div><div>{p}</div></div><div class=footer>copy 2020</div>": f"{p}\n\n{p}",
        f"<body><main><h1>Rec</h1><p>{p}</p><ul><li>two eggs<li>one cup of milk</ul><p>{p}</p></main><aside><ul><li><a href=1>other recipe</a></ul></aside>": f"Rec\n\n{p}\n\ntwo eggs\n\none cup of milk\n\n{p}",
        f'<body><nav class="{"u " * 30}menu"><a href=1>m</a></nav><div class="{"x1 " * 30}article-body"><p>{p}</p></div><select><option>a</select>': f"{p}",
        f"<body><div><p>{p}</p><p>{p}</p></div>": f"{p}\n\n{p}",
    }
    for page, want in pages.items():
        assert model.extract(page) == want, page
    whole = model.extract("<body><article>" + f"<p>{p}</p>" * 9000)
    assert whole == "\n\n".join([p] * 9000)
    begin = time.perf_counter()
    for page in ("<i>" * 20_000 + "</b>" * 20_000, "<div><li>" * 20_000 + "</p></li>" * 20_000, "<p a='>" * 20_000 + '<p b=">' * 20_000, "<section>" * 30_000 + "</div>" * 30_000, "<b><div>" * 20_000 + "</b>" * 20_000):
        model.extract(page)
    assert time.perf_counter() - begin < 15


def test_tree_marginals_agree_with_enumeration():
    import math

    nodes = [html_extract.Node(p, t, []) for p, t in ((-1, "#page"), (0, "div"), (1, "p"), (1, "nav"), (3, "li"))]
    model = html_extract.Model()
    rng = random.Random(0)
    model.unary = [rng.uniform(-1, 1) for _ in range(html_extract.HASH)]
    model.edge = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(3)]
    feats = html_extract.features(nodes)
    z = np.zeros(5)
    total = 0.0
    for y in itertools.product((0, 1), repeat=5):
        s = sum(y[i] * sum(model.unary[f] for f in feats[i]) for i in range(5)) + sum(model.edge[html_extract._kind(nodes[i].tag)][2 * y[nodes[i].parent] + y[i]] for i in range(1, 5))
        total += math.exp(s)
        z += np.array(y) * math.exp(s)
    assert np.allclose(model.infer(nodes, feats)[0], z / total)


def test_url_rules_and_reputation(spark):
    urls = ["http://a.example.com/en/71?x", "HTTP://B.COM/en/1", "https://example.net/de/80#t", "x://net/de/", None, "no scheme", "http://good.org/a", "http://bad.org/a", "http://notexample.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.org", 1)] * 200 + [("good.org", 0)] * 200 + [("good.org", None)], "host string, bad int")
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages, outcomes).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(9)] == [
        ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("b.com", "/en/1", "com/en/", "block"),
        ("example.net", "/de/80", "example.net/de/8", "block"),
        ("net", "/de/", "net/de/", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("good.org", "/a", None, "allow"),
        ("bad.org", "/a", None, "block"),
        ("notexample.com", "/en/7", "com/en/", "block"),
    ]
    assert got[7]["lower_bad"] > 0.9 > 0.1 > got[6]["lower_bad"] and got[6]["p_bad"] < 1e-9
    assert url_filters.judge_urls(pages, outcomes.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_query_takes_the_rules_of_the_contract(spark, tmp_path):
    from quadrille.llm.queries import QUERIES

    want = [
        ("x://net/de/", "net/de/", "allow"),
        ("http://a.b.net/de/7?x", "net/de/", "allow"),
        ("http://example.net/de/7", "net/de/", "allow"),
        ("http://a.example.net/de/80#t", "example.net/de/8", "block"),
        ("http://b.com/en/1", "com/en/", "block"),
        ("http://example.com/en/71", "example.com/en/7", "allow"),
        ("http://c.org/es/", "org/es/", "block"),
        ("http://c.net/den", None, "allow"),
    ]
    spark.createDataFrame([(k, u) for k, (u, *_) in enumerate(want)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 3, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(want))] == [(rule, verdict) for _, rule, verdict in want]


def test_beta_probabilities_agree_with_integration():
    rng = np.random.default_rng(0)
    theta = (np.arange(2_000_000) + 0.5) / 2_000_000 * np.pi / 2  # x = sin(theta) ** 2 takes the poles away for a, b of 0.5 or more
    for a, b in [(0.5, 0.5), (0.7, 9), (3, 0.6), (1, 1), (40, 60), (900, 1100), *rng.uniform(0.5, 30, (5, 2))]:
        log = (2 * a - 1) * np.log(np.sin(theta)) + (2 * b - 1) * np.log(np.cos(theta))
        mass = np.exp(log - log.max())
        for x in (0.05, 0.3, 0.5, 0.8):
            want = mass[np.sin(theta) ** 2 <= x].sum() / mass.sum()
            assert abs(url_filters.probability_up_to(x, np.array([a]), np.array([b]))[0] - want) < 1e-5
        q = url_filters.quantile(0.05, np.array([a]), np.array([b]))
        assert abs(url_filters.probability_up_to(q, np.array([a]), np.array([b]))[0] - 0.05) < 1e-6


def test_shrinkage_decides_hosts(spark):
    """Where hosts are like their domains, a small host leans on its domain; the same three pages block it under a bad one only."""
    rows = [(f"h{k}.bad.com", int(j < 27)) for k in range(40) for j in range(30)] + [(f"h{k}.good.com", int(j < 3)) for k in range(40) for j in range(30)]
    rows += [(f"new.{d}.com", x) for d in ("bad", "good") for x in (1, 1, 0)] + [("unseen.bad.com", None)]
    hosts = ["new.bad.com", "new.good.com", "unseen.bad.com", "h1.good.com", "h1.bad.com", "other.net"]
    pages = spark.createDataFrame([(k, f"http://{h}/x") for k, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages, spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert [got[k] for k in range(6)] == ["block", "allow", "block", "allow", "block", "allow"]


def test_pages_show_the_documents_that_their_paths_name(spark):
    """The link that gives pages their labels: the main text of every page is the text of that document."""
    import html as h

    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    for r in pages:
        body = re.search("<article>(?:<h1>.*?</h1>)?(.*?)</article>", r["html"], re.S)[1]
        shown = " ".join(h.unescape(re.sub("<[^>]*>", " ", body)).split())
        assert shown == texts[int(re.findall(r"[0-9]+", re.sub("[?#].*", "", r["url"]))[-1])]
    assert len(pages) > 100


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_queries_on_the_small_tables(spark, sf):
    from quadrille.llm.queries import QUERIES

    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    got = QUERIES["op1_language_crf"](spark, d).toPandas().merge(docs, on="doc_id")
    held = got[got["held_out"]]
    assert len(got) == len(docs) and (held["lang_pred"] == held["lang"]).mean() > 0.97
    got = QUERIES["op5_secret_scan"](spark, d).toPandas()
    for r, text in zip(got.sort_values("doc_id").to_dict("records"), docs.sort_values("doc_id")["text"], strict=True):
        spans = brute_spans(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
    pages = pd.read_parquet(f"{d}/pages.parquet")
    got = QUERIES["op4_html_tree"](spark, d).toPandas().merge(pages, on="page_id")
    import html as h

    for text, page in zip(got["text"], got["html"], strict=True):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(h.unescape(re.sub("<(?:b|/b|br)>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inner))
        assert text == "\n\n".join(b for b in blocks if b)
    assert QUERIES["op10_url_filter"](spark, d).count() == len(pages)


def test_every_language_is_learned():
    """More languages than there are letters of the alphabet to tell them by: all of them are predicted."""
    rng = random.Random(4)
    stems = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for _ in range(280)]
    say = lambda k, n: " ".join(rng.choice(stems[k]) for _ in range(n))
    model = language_id.train([(f"l{k:03}", say(k, 12)) for k in range(280) for _ in range(4)])
    names, _ = model.predict([say(k, 8) for k in range(280)])
    assert len(model.labels) == 280 and sum(n == f"l{k:03}" for k, n in enumerate(names)) > 270

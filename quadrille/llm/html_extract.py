"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block-level element is a node with two states, content or not. Unary potentials come from its tag, words of
its class, id and role, the length, link share and part of the page of its text; each edge has a parent-child potential that
depends on the kind of the child. Sum-product messages go up and then down the tree, which gives exact marginals
in two passes. Weights are trained by gradient ascent of the likelihood on labelled pages; without pages of the
user's own, ``labelled_pages`` makes some from templates with menus, notices, adverts, forms and comments. A node is content if
it holds content anywhere below it. One task fits the model; the driver only passes it on.

A block is a run of text between block-level borders. White space inside becomes one space, character references
are decoded, blocks of content nodes are joined by a blank line. Null and empty pages give an empty text. Markup
may be cut off or unclosed anywhere, and takes time in proportion to its length: the open elements of every name are listed, so
that no end tag looks for its start. Quotes only count behind an equals sign; one that is never closed is part of the tag up to
the next ``>``. Rows are independent of each other; repeated rows give equal results; ids and urls pass through unchanged.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import releasing, texts_of, with_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea select object".split())
#: If one of these is never closed, the rest of the page belongs to it; other raw elements are then as good as absent.
ENDLESS = frozenset("script style textarea iframe noscript".split())
CHROME = frozenset("nav header footer aside form button fieldset menu dialog label legend".split())
CONTAINER = frozenset("html body div section main article table tbody thead tfoot tr ul ol dl figure details center".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption address caption summary title".split())
BLOCK = CHROME | CONTAINER | TEXTUAL
#: A start tag closes these elements, up to the nearest element that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
HASH = 4096
ROUNDS, RATE, PAGES = 60, 0.3, 400
_TAG = re.compile(r"<(?:!--(?:-?>|.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)|/[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-label)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]{2,}")
_RAW_END = {name: re.compile(f"</{name}(?![^\\s/>])[^>]*>", re.I) for name in RAW}


class Node:
    __slots__ = ("parent", "tag", "words", "text", "links", "blocks", "gold")

    def __init__(self, parent: int, tag: str, words: list[str], gold: int | None = None):
        self.parent, self.tag, self.words, self.gold = parent, tag, words, gold
        self.text = self.links = self.blocks = 0


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level nodes in page order (parents first) and blocks as (node, text)."""
    nodes, blocks = [Node(-1, "#page", [])], []
    if not isinstance(page, str) or not page:
        return nodes, blocks
    stack: list[tuple[str, int]] = [("#page", 0)]  # open block-level elements with their nodes
    places: dict[str, list[int]] = {}  # of the open elements of every name in the stack
    run: list[str] = []
    unclosed: set[str] = set()  # names without an end tag from here on
    links, at, n = 0, 0, len(page)

    def end_block():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.text += len(text)
                node.blocks += 1
                blocks.append((stack[-1][1], text))

    def innermost(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(k: int):
        end_block()
        for name, _ in stack[k:]:
            places[name].pop()
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            run.append(piece)
            if links:
                nodes[stack[-1][1]].links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                k = innermost((name,))
                if k and k > innermost(HOLDS.get(name, () if name in TABLE else ("td", "th", "caption"))):
                    close(k)
                elif name == "p":
                    end_block()
            elif name == "a":
                links = max(0, links - 1)
            elif name == "br":
                run.append(" ")
            continue
        if name in VOID:
            run.append(" ")
            if name == "hr":
                end_block()
            continue
        if name in RAW:
            # a slash at the end closes none of them but svg
            if not (name == "svg" and m[3].endswith("/")):
                e = None if name in unclosed else _RAW_END[name].search(page, at)
                if e:
                    at = e.end()
                elif name in ENDLESS:
                    at = n
                else:  # nor is there one behind any later position
                    unclosed.add(name)
            continue
        if name in BLOCK:
            end_block()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                k = innermost(CLOSES[name])
                if k > innermost(HOLDS[name]):
                    close(k)
            words = [w.lower() for a in _ATTR.finditer(m[3]) for w in ([a[1]] if a[1].lower() == "hidden" else _NAME.findall(a[2] or a[3] or a[4] or ""))] if m[3] else []
            nodes.append(Node(stack[-1][1], name, words))
            places.setdefault(name, []).append(len(stack))
            stack.append((name, len(nodes) - 1))
            links = 0
        elif name == "a":
            links += 1
    end_block()
    return nodes, blocks


def _kind(tag: str) -> int:
    return 0 if tag in CHROME else 2 if tag in TEXTUAL else 1


def features(nodes: list[Node]) -> list[list[int]]:
    """Hashed features of every node."""
    out = []
    whole = max(1, sum(v.text for v in nodes))
    for v in nodes:
        names = [f"t={v.tag}", f"k={_kind(v.tag)}"]
        names += [f"w={w}" for w in dict.fromkeys(v.words)] or ["w=none"]
        names.append(f"n={int(math.log2(1 + v.text))}" if v.text else "n=none")
        if v.text:
            names.append(f"a={min(4, 4 * v.links // v.text)}")
            names.append(f"s={4 * v.text // whole}")
        if v.parent >= 0:
            names.append(f"p={nodes[v.parent].tag}>{v.tag}")
        out.append([zlib.crc32(x.encode()) % HASH for x in names])
    return out


class Model:
    def __init__(self):
        self.unary = [0.0] * HASH
        self.edge = [[0.0] * 4 for _ in range(3)]  # by kind of child: parent state * 2 + child state

    def infer(self, nodes: list[Node], feats: list[list[int]]) -> tuple[list[float], list[tuple[float, ...]]]:
        """Marginals of content, and of the four states of each node's edge to its parent."""
        n, w = len(nodes), self.unary
        score = [sum([w[f] for f in fs]) for fs in feats]
        tables = [[math.exp(x) for x in e] for e in self.edge]
        low, high = [1.0] * n, [1.0] * n  # products of what the children send
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        own = [1.0] * n
        for i in range(n - 1, -1, -1):
            own[i] = x = math.exp(max(-30.0, min(30.0, score[i])))
            a, b = low[i], high[i] * x
            s = a + b
            low[i], high[i] = a, b = a / s, b / s
            p = nodes[i].parent
            if p >= 0:
                e = tables[_kind(nodes[i].tag)]
                m0, m1 = e[0] * a + e[1] * b, e[2] * a + e[3] * b
                s = m0 + m1
                up[i] = (m0 / s, m1 / s)
                x0, x1 = low[p] * up[i][0], high[p] * up[i][1]
                s = x0 + x1
                low[p], high[p] = (x0 / s, x1 / s) if s > 1e-250 else (0.5, 0.5)
        marginal, edges = [0.0] * n, [(0.0,) * 4] * n
        full = [(low[0], high[0])] * n
        marginal[0] = high[0]
        for i in range(1, n):
            p = nodes[i].parent
            e = tables[_kind(nodes[i].tag)]
            f0, f1 = full[p]
            c0, c1 = f0 / max(up[i][0], 1e-300), f1 / max(up[i][1], 1e-300)
            j = (c0 * e[0] * low[i], c0 * e[1] * high[i], c1 * e[2] * low[i], c1 * e[3] * high[i])
            s = sum(j) or 1.0
            j = tuple(x / s for x in j)
            edges[i] = j
            marginal[i] = j[1] + j[3]
            full[i] = (j[0] + j[2], j[1] + j[3])
        return marginal, edges

    def extract(self, page: str | None) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        content, _ = self.infer(nodes, features(nodes))
        return "\n\n".join(text for v, text in blocks if content[v] >= 0.5)


def train(pages: list[tuple[list[Node], list[list[int]]]], rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Gradient ascent (AdaGrad) of the likelihood of nodes' gold states."""
    model = Model()
    sq_u, sq_e = np.full(HASH, 1e-1), np.full((3, 4), 1e-1)
    for _ in range(rounds):
        gu, ge = np.zeros(HASH), np.zeros((3, 4))
        for nodes, feats in pages:
            content, edges = model.infer(nodes, feats)
            for i, v in enumerate(nodes):
                d = v.gold - content[i]
                for f in feats[i]:
                    gu[f] += d
                if v.parent >= 0:
                    k = _kind(v.tag)
                    ge[k, nodes[v.parent].gold * 2 + v.gold] += 1
                    for s in range(4):
                        ge[k, s] -= edges[i][s]
        gu -= 0.05 * np.array(model.unary)
        sq_u += gu * gu
        sq_e += ge * ge
        model.unary = (np.array(model.unary) + rate * gu / np.sqrt(sq_u)).tolist()
        model.edge = (np.array(model.edge) + rate * ge / np.sqrt(sq_e)).tolist()
    return model


def labelled_pages(count: int = PAGES, seed: int = 3) -> list[tuple[list[Node], list[list[int]]]]:
    """Pages from templates; the words of their texts begin with c in content and x elsewhere, which gives the labels."""
    r = random.Random(seed)
    pages = []
    for _ in range(count):
        nodes, blocks = parse(_template(r))
        for v in nodes:
            v.gold = 0
        for v, text in blocks:
            if text.startswith("c"):
                nodes[v].gold = 1
        for v in reversed(nodes[1:]):
            nodes[v.parent].gold |= v.gold
        pages.append((nodes, features(nodes)))
    return pages


def _template(r: random.Random) -> str:
    def words(mark: str, low: int, high: int) -> str:
        return " ".join(mark + "".join(r.choice("aeiourstln") for _ in range(r.randint(1, 8))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(low, high)))

    def box(names: list[str], inner: str, tags=("div", "section")) -> str:
        name = r.choice(names)
        at = r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice("abc")}{r.randint(1, 9)}"', f' class="block {name}"'])
        tag = r.choice(tags)
        return f"<{tag}{at}>{inner}</{tag}>"

    def links(mark: str, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(mark, 1, 4)}</a></li>' for k in range(n)) + "</ul>"

    def para(mark: str) -> str:
        text = words(mark, 1, 5) if r.random() < 0.25 else words(mark, 5, 120)
        if r.random() < 0.25:
            text = f"<b>{text}" + r.choice(["</b>", "", "<br>"])
        if r.random() < 0.2:
            text += f' <a href="/x">{words(mark, 1, 3)}</a> {words(mark, 2, 20)}'
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", ""])

    def maybe(p: float, f) -> str:
        return f() if r.random() < p else ""

    def notice() -> str:
        inner = r.choice([words("x", 4, 40), f"<p>{words('x', 4, 40)}</p>", f"<p>{words('x', 4, 30)}</p><button>{words('x', 1, 2)}</button>"])
        return box(["cookie", "cookie-notice", "notice", "banner", "alert", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "message"], inner, ("div", "div", "section", "aside", "dialog"))

    def advert() -> str:
        inner = r.choice([words("x", 3, 30), f"<p>{words('x', 3, 30)}</p>", f'<a href="/ad">{words("x", 2, 12)}</a>'])
        return box(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor"], inner, ("div", "div", "aside", "section"))

    def form() -> str:
        return r.choice(["<form>", '<form class="search">', '<form id="signup">']) + f"<label>{words('x', 1, 4)}</label><input name=q>" + maybe(0.5, lambda: f"<p>{words('x', 3, 15)}</p>") + f"<button>{words('x', 1, 2)}</button></form>"

    def sidebar() -> str:
        return box(["sidebar", "side", "widget", "related", "rail", "recommended", "trending", "popular", "widgets"], maybe(0.6, lambda: f"<h3>{words('x', 1, 4)}</h3>") + r.choice([links("x", r.randint(2, 6)), f"<p>{words('x', 5, 50)}</p>", f"<p>{words('x', 5, 50)}</p>" * 2]), ("aside", "aside", "div", "section"))

    def comments() -> str:
        one = lambda: box(["comment", "comment-body", "reply", "response"], maybe(0.6, lambda: r.choice([f"<h4>{words('x', 1, 3)}</h4>", f"<span>{words('x', 1, 3)}</span>"])) + (para("x") if r.random() < 0.8 else words("x", 4, 60)), ("div", "div", "li", "article"))
        inner = maybe(0.6, lambda: f"<h2>{words('x', 1, 3)}</h2>") + "".join(one() if r.random() < 0.8 else para("x") for _ in range(r.randint(1, 5))) + maybe(0.3, form)
        return box(["comments", "comment-list", "respond", "discussion", "replies", "disqus", "responses"], inner, ("section", "div", "div", "aside"))

    def noise() -> str:
        """Names that tell nothing: generic ones, or made up."""
        some = ["wrapper", "container", "row", "col", "inner", "block", "box", "grid", "layout", "section", "main", "page", "site", "wrap", "holder", "region", "flex", "mx", "px", "lg"]
        return " ".join(r.choice([r.choice(some), words("", 1, 1).strip(",.") + str(r.randint(1, 99))]) for _ in range(r.choice([0, 1, 1, 2, 3, 9])))

    def nest(inner: str, p: float) -> str:
        while r.random() < p:
            name = noise()
            inner = f'<div class="{name}">{inner}</div>' if name else f"<div>{inner}</div>"
        return inner

    def article() -> str:
        shape = r.random()
        if shape < 0.15:  # without elements around it, or with breaks for paragraphs
            title = r.choice([f"<h1>{words('c', 2, 12)}</h1>", f"<h2>{words('c', 2, 12)}</h2>", ""])
            if r.random() < 0.5:
                return title + r.choice(["<br>", "<br><br>", "<hr>"]).join(words("c", 8, 90) for _ in range(r.randint(1, 8)))
            return title + "".join(para("c") for _ in range(r.randint(2, 8)))
        if shape < 0.32:  # a div for each paragraph
            body = "".join(f"<div>{words('c', 8, 90)}</div>" for _ in range(r.randint(2, 8)))
            return nest(f"<h1>{words('c', 2, 12)}</h1>" + body, 0.6)
        parts = [f"<h1>{words('c', 2, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            parts.append(para("c"))
            parts.append(maybe(0.12, lambda: f"<h2>{words('c', 2, 8)}</h2>"))
            parts.append(maybe(0.06, lambda: "<ul>" + "".join(f"<li>{words('c', 2, 20)}</li>" for _ in range(3)) + "</ul>"))
            parts.append(maybe(0.05, lambda: f"<blockquote>{words('c', 5, 40)}</blockquote>"))
            parts.append(maybe(0.04, lambda: "<table>" + "".join(f"<tr><td>{words('c', 1, 4)}</td><td>{words('c', 1, 4)}</td></tr>" for _ in range(2)) + "</table>"))
            parts.append(maybe(0.03, lambda: f"<pre>{words('c', 3, 20)}</pre>"))
            parts.append(maybe(0.05, advert))
            parts.append(maybe(0.03, lambda: box(["share", "social", "toolbar", "tags", "meta", "byline"], words("x", 1, 8))))
        if r.random() < 0.2:  # what readers and others add, inside the article's element
            parts.append(r.choice([comments, comments, sidebar, form, notice])())
        inner = nest("".join(parts), 0.25)
        wrap = r.random()
        if wrap < 0.55:
            inner = f"<article>{inner}</article>" if r.random() < 0.7 else box(["post", "story", "entry"], inner, ("article",))
        if wrap > 0.4:
            inner = box(["content", "main-content", "post-body", "entry-content", "article-body", "story", "post", "text", "main", "page-content"], inner, ("div", "div", "main", "section"))
        if r.random() < 0.3:
            inner = f"<main>{inner}</main>"
        return nest(inner, 0.35)

    header = lambda: r.choice([f"<header><h2>{words('x', 1, 4)}</h2></header>", f"<header>{words('x', 1, 6)}</header>", box(["header", "masthead", "top", "site-header", "logo"], r.choice([words("x", 1, 6), f"<h2>{words('x', 1, 4)}</h2>", links("x", 3)]))])
    menu = lambda: r.choice([f"<nav>{links('x', r.randint(3, 8))}</nav>", box(["menu", "nav", "navbar", "navigation", "breadcrumb", "topnav"], links("x", r.randint(3, 8)))])
    footer = lambda: r.choice([f"<footer>{words('x', 2, 20)}</footer>", f"<footer><p>{words('x', 2, 20)}</p></footer>", box(["footer", "bottom", "copyright", "legal", "site-footer"], r.choice([words("x", 2, 20), f"<p>{words('x', 2, 20)}</p>", links("x", 4)]))])
    parts = [maybe(0.5, header), maybe(0.8, menu), maybe(0.25, notice), maybe(0.4, advert), maybe(0.2, form), maybe(0.25, sidebar)]
    parts += [article()] + [maybe(0.3, advert), maybe(0.3, sidebar), maybe(0.35, comments), maybe(0.2, form), maybe(0.2, notice), maybe(0.85, footer), maybe(0.1, notice)]
    body = nest("".join(parts), 0.4)
    if r.random() < 0.15:
        return body
    return f"<!DOCTYPE html><html><head><title>{words('x', 2, 9)}</title><style>p{{}}</style></head><body>{body}" + r.choice(["</body></html>", ""])


def fit(spark: SparkSession) -> Model:
    """The model for generated pages, fitted in one task."""

    @releasing
    def run(batches):
        for batch in batches:
            if len(batch):
                yield pa.record_batch({"model": pa.array([pickle.dumps(train(labelled_pages()))], pa.binary())})

    return pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()["model"])


def extract_text(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df.sparkSession))
    narrow = df.select(df[id_col].alias("id"), df[url_col].alias("u"), df[html_col].alias("h"))

    @releasing
    def run(batches):
        for batch in batches:
            texts = [shared.value.extract(h) for h in texts_of(batch, "h")]
            yield with_columns(batch, ["id", "u"], ["text", "n_chars"], [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())])

    id_kind, url_kind = (df.schema[c].dataType.simpleString() for c in (id_col, url_col))
    out = narrow.mapInArrow(run, f"id {id_kind}, u {url_kind}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "u": url_col})

"""One weighted graph for each window and kind of weight: selection, topology, nulls, matrix regressions, inference.

What is a sum or a join is SQL: selection, density, clustering, modularity of given communities, overlap of edge sets,
observed correlations. Kernels that walk one window's graph (components, communities, rewiring, permutations)
run in grouped pandas, a group for each window and kind, whose size is bounded by the members of a window.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS, pooled_weight
from .draws import base, permutations, uniforms
from .labels import tag_windows
from .pairs import valid_pairs
from .sweep import guarded_corr

KINDS = ("e00", "pooled", "s_odd")
METRICS = ("modularity", "giant_frac", "avg_clustering")
#: Statistics of permutations count as reached within this margin of the observed one.
TIE = 1e-12
#: Decimal places at which gains of modularity are compared, so that equal ones are equal however they were summed.
PLACES = 12
_METRIC_SCHEMA = "n_nodes int, n_edges int, edge_density double, avg_clustering double, giant_frac double, modularity double, n_communities int"


def edge_weights(stats: DataFrame) -> DataFrame:
    """Valid pairs with weights e00, pooled and s_odd, one row for each graph: window_id, graph, src, dst, w."""
    e, n = [F.col(f"E{c}") for c in CELLS], [F.col(f"N{c}") for c in CELLS]
    ok = valid_pairs(stats).filter("permno_a <> permno_b")
    kinds = F.array(*[F.struct(F.lit(k).alias("graph"), w.alias("w")) for k, w in (("e00", F.col("E00")), ("pooled", pooled_weight(e, n)), ("s_odd", F.col("s_odd")))])
    return ok.select("window_id", F.col("permno_a").alias("src"), F.col("permno_b").alias("dst"), F.explode(kinds).alias("k")).select("window_id", "k.graph", "src", "dst", "k.w").filter("w IS NOT NULL")


def nodes_of(weights: DataFrame) -> DataFrame:
    """Endpoints of all weighted pairs, so members without a selected edge stay."""
    return weights.select("window_id", "graph", F.explode(F.array("src", "dst")).alias("node")).distinct()


def top_edges(weights: DataFrame, share: float = 0.05) -> DataFrame:
    """The share of edges of largest |w| in each graph, one at least; ties go to the lower endpoints."""
    by = Window.partitionBy("window_id", "graph")
    ranked = weights.withColumn("r", F.row_number().over(by.orderBy(F.desc(F.abs("w")), "src", "dst"))).withColumn("n", F.count(F.lit(1)).over(by))
    return ranked.filter(F.col("r") <= F.greatest(F.lit(1), F.bround(share * F.col("n")).cast("int"))).drop("r", "n")


def absolute_edges(weights: DataFrame, bound: float = 2.0) -> DataFrame:
    """Edges of s_odd at or above the bound, as graph ``s_odd_abs``."""
    return weights.filter((F.col("graph") == "s_odd") & (F.col("w") >= bound)).withColumn("graph", F.lit("s_odd_abs"))


def density(weights: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes_of(weights).groupBy("window_id", "graph").agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy("window_id", "graph").agg(F.count(F.lit(1)).alias("n_edges"))
    both = n.join(m, ["window_id", "graph"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return both.withColumn("edge_density", F.coalesce(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))


def clustering(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean local clustering over all members, by counting triangles with two equi-joins."""
    key = ["window_id", "graph"]
    e = edges.select(*key, "src", "dst")
    wedge = e.alias("x").join(e.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key] + [F.col("x.dst") == F.col("y.src")]).select(*[F.col(f"x.{k}").alias(k) for k in key], F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    tri = wedge.join(e.withColumnsRenamed({"src": "a", "dst": "c"}), [*key, "a", "c"])
    t = tri.select(*key, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("t"))
    deg = e.select(*key, F.explode(F.array("src", "dst")).alias("node")).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("d"))
    local = nodes_of(weights).join(deg, [*key, "node"], "left").join(t, [*key, "node"], "left")
    c = F.coalesce(F.try_divide(2.0 * F.col("t"), F.col("d") * (F.col("d") - 1)), F.lit(0.0))
    return local.groupBy(*key).agg(F.avg(c).alias("avg_clustering"))


def partition_modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Weighted modularity of given communities (window_id, graph, node, community)."""
    key = ["window_id", "graph"]
    s, d = (communities.withColumnsRenamed({"node": n, "community": f"c_{n}"}) for n in ("src", "dst"))
    e = edges.join(s, [*key, "src"]).join(d, [*key, "dst"])
    inner = e.filter("c_src = c_dst").groupBy(*key, F.col("c_src").alias("c")).agg(F.sum("w").alias("l"))
    deg = e.select(*key, "w", F.explode(F.array("c_src", "c_dst")).alias("c")).groupBy(*key, "c").agg(F.sum("w").alias("k"))
    m = e.groupBy(*key).agg(F.sum("w").alias("m"))
    parts = deg.join(inner, [*key, "c"], "left").join(m, key)
    return parts.groupBy(*key).agg(F.sum(F.try_divide(F.coalesce("l", F.lit(0.0)), "m") - F.pow(F.try_divide(F.col("k"), 2 * F.col("m")), 2)).alias("modularity"))


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    key = ["window_id", "graph", "src", "dst"]
    both = a.select(*key, F.lit(1).alias("a")).join(b.select(*key, F.lit(1).alias("b")), key, "full")
    return both.groupBy("window_id", "graph").agg(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1))).alias("jaccard"))


# Kernels on one graph: n nodes numbered from 0, edges (i, j, weight).


def components(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """The least node that each node is connected to."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j, _ in edges:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def modularity(edges: list[tuple[int, int, float]], community: list[int]) -> float:
    m = sum(w for *_, w in edges)
    if m == 0:
        return float("nan")
    inner: dict[int, float] = {}
    degree: dict[int, float] = {}
    for i, j, w in edges:
        for c in (community[i], community[j]):
            degree[c] = degree.get(c, 0.0) + w
        if community[i] == community[j]:
            inner[community[i]] = inner.get(community[i], 0.0) + w
    return sum(inner.get(c, 0.0) / m - (k / (2 * m)) ** 2 for c, k in degree.items())


def greedy_communities(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Communities by merging, again and again, the linked pair that raises weighted modularity most.

    Each pair's gain sits in a heap with the versions of both sides; stale entries are skipped. Gains are compared at ``PLACES``
    places, ties go to the lower numbers. Merging stops when no gain is positive.
    """
    m = sum(w for *_, w in edges)
    community = list(range(n))
    if m == 0:
        return community
    links: list[dict[int, float]] = [{} for _ in range(n)]
    degree = [0.0] * n
    for i, j, w in edges:
        links[i][j] = links[i].get(j, 0.0) + w
        links[j][i] = links[j].get(i, 0.0) + w
        degree[i] += w
        degree[j] += w
    version = [0] * n
    loss = lambda a, b: round(degree[a] * degree[b] / (2 * m * m) - links[a][b] / m, PLACES)
    heap = [(loss(a, b), a, b, 0, 0) for a in range(n) for b in links[a] if a < b]
    heapq.heapify(heap)
    members = [[i] for i in range(n)]
    while heap:
        g, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb:
            continue
        if g >= 0:
            break
        for c, w in links[b].items():
            del links[c][b]
            if c != a:
                links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
        links[b] = {}
        degree[a] += degree[b]
        members[a] += members[b]
        version[a] += 1
        version[b] = -1
        for c in links[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (loss(a, c), x, y, version[x], version[y]))
    for c, nodes in enumerate(members):
        if version[c] >= 0:
            for i in nodes:
                community[i] = c
    return community


def graph_metrics(n: int, edges: list[tuple[int, int, float]]) -> tuple:
    """Values of the metrics' schema."""
    m = len(edges)
    if n == 0:
        return (0, 0, None, None, None, None, None)
    dens = 2.0 * m / (n * (n - 1)) if n > 1 else 0.0
    if m == 0:
        return (n, 0, dens, 0.0, 1.0 / n, 0.0, n)
    near: list[set[int]] = [set() for _ in range(n)]
    for i, j, _ in edges:
        near[i].add(j)
        near[j].add(i)
    local = [sum(len(near[i] & near[j]) for j in near[i]) / (len(near[i]) * (len(near[i]) - 1)) if len(near[i]) > 1 else 0.0 for i in range(n)]
    giant = max(np.unique(components(n, edges), return_counts=True)[1])
    community = greedy_communities(n, edges)
    q = modularity(edges, community)
    return (n, m, dens, float(np.mean(local)), giant / n, q if np.isfinite(q) else None, len(set(community)))


def rewired(n: int, edges: list[tuple[int, int, float]], stream: int) -> list[tuple[int, int, float]] | None:
    """As many degree-preserving double swaps as edges, in ten times as many tries; None if they do not suffice.

    A try takes three numbers of the stream: two edges, and which ends of the second one swap. Swapped edges have weight 1, as they stand
    for no measured pair.
    """
    e = [(i, j) for i, j, _ in edges]
    weight = {frozenset(x): w for x, (_, _, w) in zip(e, edges, strict=True)}
    present = set(weight)
    if n < 4 or len(e) < 2:
        return None
    done = 0
    for first, second, turn in uniforms(stream, np.arange(30 * len(e))).reshape(-1, 3):
        if done == len(e):
            break
        x, y = int(first * len(e)), int(second * len(e))
        (a, b), (c, d) = e[x], e[y]
        if turn < 0.5:
            c, d = d, c
        if x == y or len({a, b, c, d}) < 4 or frozenset((a, d)) in present or frozenset((c, b)) in present:
            continue
        present -= {frozenset((a, b)), frozenset((c, d))}
        present |= {frozenset((a, d)), frozenset((c, b))}
        e[x], e[y] = (a, d), (c, b)
        done += 1
    return [(i, j, weight.get(frozenset((i, j)), 1.0)) for i, j in e] if done == len(e) else None


def _numbered(f: pd.DataFrame) -> tuple[list, list[tuple[int, int, float]]]:
    """Nodes in order and selected edges by number; rows that are not selected carry nodes only."""
    nodes = sorted(set(f["src"]) | set(f["dst"]))
    at = {v: k for k, v in enumerate(nodes)}
    chosen = f[f["selected"]].sort_values(["src", "dst"])
    return nodes, [(at[a], at[b], float(w)) for a, b, w in zip(chosen["src"], chosen["dst"], chosen["w"], strict=True)]


def _marked(weights: DataFrame, share: float, bound: float | None) -> DataFrame:
    """The selected edges of every graph, a row for each member besides (so that lone ones are seen), and the rule as text."""

    def graph(edges: DataFrame, nodes: DataFrame, rule: str) -> DataFrame:
        lone = nodes.select("window_id", "graph", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("w"), F.lit(False).alias("selected"))
        return edges.select("window_id", "graph", "src", "dst", "w", F.lit(True).alias("selected")).union(lone).withColumn("threshold", F.lit(rule))

    nodes = nodes_of(weights)
    out = graph(top_edges(weights, share), nodes, f"top-{share:.0%}")
    if bound is not None:
        out = out.union(graph(absolute_edges(weights, bound), nodes.filter("graph = 's_odd'").withColumn("graph", F.lit("s_odd_abs")), f">={bound:g}"))
    return out


def _metrics_of(key, f):
    nodes, edges = _numbered(f)
    return pd.DataFrame([(key[0], key[1], key[2], *graph_metrics(len(nodes), edges))], columns=["window_id", "graph", "threshold", *[c.split()[0] for c in _METRIC_SCHEMA.split(", ")]])


def _window_info(stats: DataFrame, episodes: DataFrame | None) -> DataFrame:
    info = stats.groupBy("window_id").agg(F.min("win_start").alias("win_start"), F.min("win_end").alias("win_end"), F.min("regime").alias("regime"))
    if episodes is not None:
        info = info.join(tag_windows(info, episodes), "window_id", "left")
    return info.drop("win_end")


def network_metrics(stats: DataFrame, share: float = 0.05, bound: float | None = 2.0, episodes: DataFrame | None = None) -> DataFrame:
    """Topology of the three density-matched graphs and the absolute one, for every window."""
    marked = _marked(edge_weights(stats), share, bound)
    m = marked.groupBy("window_id", "graph", "threshold").applyInPandas(_metrics_of, f"window_id int, graph string, threshold string, {_METRIC_SCHEMA}")
    return m.join(F.broadcast(_window_info(stats, episodes)), "window_id")


def graph_communities(stats: DataFrame, share: float = 0.05) -> DataFrame:
    """window_id, graph, node, community (its least member)."""

    def run(key, f):
        nodes, edges = _numbered(f)
        c = greedy_communities(len(nodes), edges)
        least: dict[int, int] = {}
        for v, k in zip(nodes, c, strict=True):
            least[k] = min(least.get(k, v), v)
        return pd.DataFrame({"window_id": key[0], "graph": key[1], "node": nodes, "community": [least[k] for k in c]})

    return _marked(edge_weights(stats), share, None).groupBy("window_id", "graph").applyInPandas(run, "window_id int, graph string, node int, community int")


def giant_fraction(stats: DataFrame, share: float = 0.05) -> DataFrame:
    return network_metrics(stats, share, None).select("window_id", "graph", "n_nodes", "giant_frac")


def config_excess(stats: DataFrame, share: float = 0.05, n_rewire: int = 20, seed: int = 0, episodes: DataFrame | None = None) -> DataFrame:
    """Metrics against their mean and deviation over degree-preserving rewirings."""
    cols = [f"{m}{s}" for m in METRICS for s in ("", "_null_mean", "_excess", "_z")]

    def run(key, f):
        nodes, edges = _numbered(f)
        pick = lambda t: dict(zip([c.split()[0] for c in _METRIC_SCHEMA.split(", ")], t, strict=True))
        real = pick(graph_metrics(len(nodes), edges))
        null = []
        for k in range(n_rewire):
            g = rewired(len(nodes), edges, base("rewire", *key, seed, k))
            if g is not None:
                null.append(pick(graph_metrics(len(nodes), g)))
        row = []
        for m in METRICS:
            v = [x[m] for x in null if x[m] is not None]
            mean = float(np.mean(v)) if v else None
            sd = float(np.std(v, ddof=1)) if len(v) > 1 else None
            ex = real[m] - mean if mean is not None and real[m] is not None else None
            row += [real[m], mean, ex, ex / sd if ex is not None and sd else None]
        return pd.DataFrame([(key[0], key[1], *row)], columns=["window_id", "graph", *cols])

    out = _marked(edge_weights(stats), share, None).groupBy("window_id", "graph").applyInPandas(run, "window_id int, graph string, " + ", ".join(f"{c} double" for c in cols))
    return out.join(F.broadcast(_window_info(stats, episodes)), "window_id")


def rewired_degrees(stats: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """window_id, graph, node, degree in one rewiring of each graph (in the graph itself, where it has too few swaps)."""

    def run(key, f):
        nodes, edges = _numbered(f)
        new = rewired(len(nodes), edges, base("rewire", *key, seed, 0)) or edges
        degree = np.bincount([v for i, j, _ in new for v in (i, j)], minlength=len(nodes)).astype(int)
        return pd.DataFrame({"window_id": key[0], "graph": key[1], "node": nodes, "degree": degree})

    return _marked(edge_weights(stats), share, None).groupBy("window_id", "graph").applyInPandas(run, "window_id int, graph string, node int, degree int")


def rewired_edges(stats: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """window_id, graph, src, dst, w of one rewiring of each graph that has swaps enough."""

    def run(key, f):
        nodes, edges = _numbered(f)
        new = rewired(len(nodes), edges, base("rewire", *key, seed, 0)) or []
        ends = [(*sorted((nodes[i], nodes[j])), w) for i, j, w in new]
        return pd.DataFrame([(*key, *e) for e in ends], columns=["window_id", "graph", "src", "dst", "w"])

    return _marked(edge_weights(stats), share, None).groupBy("window_id", "graph").applyInPandas(run, "window_id int, graph string, src int, dst int, w double")


def permutation_difference(a: np.ndarray, b: np.ndarray, n_perm: int, stream: int) -> tuple:
    """(difference of means, two-sided p, sizes); no p below 2 values a side."""
    a, b = a[np.isfinite(a)], b[np.isfinite(b)]
    if len(a) < 2 or len(b) < 2:
        return None, None, len(a), len(b)
    both, diff, ge = np.concatenate([a, b]), a.mean() - b.mean(), 0
    for k in range(0, n_perm, 2000):
        x = both[permutations(stream, np.arange(k, min(n_perm, k + 2000)) * len(both), len(both))]
        ge += int((np.abs(x[:, : len(a)].mean(axis=1) - x[:, len(a) :].mean(axis=1)) >= abs(diff) - TIE).sum())
    return float(diff), (1 + ge) / (n_perm + 1), len(a), len(b)


def window_inference(excess: DataFrame, kind: str = "e00", metrics=METRICS, suffix: str = "_excess", n_perm: int = 20_000, seed: int = 0) -> DataFrame:
    """Crisis against calm windows, and food against financial ones (a window may be both). A row for each window at most."""
    d = excess.filter(F.col("graph") == kind)
    types = F.split(F.coalesce("crisis_types", F.lit("none")), ";") if "crisis_types" in d.columns else F.array(F.lit("none"))
    sides = [("crisis_vs_calm", 1, F.col("regime") == "crisis"), ("crisis_vs_calm", 2, F.col("regime") == "calm"), ("food_vs_financial", 1, F.array_contains(types, "food")), ("food_vs_financial", 2, F.array_contains(types, "financial"))]
    rows = None
    for contrast, side, cond in sides:
        for m in metrics:
            r = d.filter(cond).select(F.lit(contrast).alias("contrast"), F.lit(m).alias("metric"), F.lit(side).alias("side"), "window_id", F.col(f"{m}{suffix}").cast("double").alias("v"))
            rows = r if rows is None else rows.unionByName(r)

    def run(key, f):
        f = f.sort_values("window_id")
        a, b = (f.loc[f["side"] == k, "v"].to_numpy(float) for k in (1, 2))
        diff, p, na, nb = permutation_difference(a, b, n_perm, base("diff", *key, seed))
        mean = lambda v: float(np.nanmean(v)) if np.isfinite(v).any() else None
        return pd.DataFrame([(key[0], key[1], kind, mean(a), mean(b), na, nb, diff, p)], columns=["contrast", "metric", "graph", "mean_group1", "mean_group2", "n_group1", "n_group2", "diff", "perm_p"])

    return rows.groupBy("contrast", "metric").applyInPandas(run, "contrast string, metric string, graph string, mean_group1 double, mean_group2 double, n_group1 int, n_group2 int, diff double, perm_p double")


# Matrix correlation and regression


def qap_pairs(stats: DataFrame, node_subsample: int | None = None) -> DataFrame:
    """Wide weights of each window's pairs, kept to its first members if asked."""
    e, n = [F.col(f"E{c}") for c in CELLS], [F.col(f"N{c}") for c in CELLS]
    ok = valid_pairs(stats).select("window_id", "regime", "permno_a", "permno_b", pooled_weight(e, n).alias("pooled"), F.col("E00").alias("e00"), "s_odd")
    if node_subsample:
        nodes = ok.select("window_id", F.explode(F.array("permno_a", "permno_b")).alias("p")).distinct()
        nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy("window_id").orderBy("p"))).filter(F.col("r") <= node_subsample)
        for k in "ab":
            ok = ok.join(nodes.select("window_id", F.col("p").alias(f"permno_{k}")), ["window_id", f"permno_{k}"], "left_semi")
    return ok


def qap_observed(stats: DataFrame) -> DataFrame:
    """Correlations of the three weights over a window's pairs, and R2 of s_odd on pooled and e00, from moments."""
    p = qap_pairs(stats)
    g = p.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"), guarded_corr("pooled", "e00").alias("r_pooled_e00"), guarded_corr("pooled", "s_odd").alias("r_pooled_s_odd"), guarded_corr("e00", "s_odd").alias("r_e00_s_odd")
    )
    a, b, c = F.col("r_pooled_s_odd"), F.col("r_e00_s_odd"), F.col("r_pooled_e00")
    r2 = F.when(1 - c * c > 1e-12, F.try_divide(a * a + b * b - 2 * a * b * c, 1 - c * c))
    return g.withColumn("gate_r2", r2)


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    total = ((y - y.mean()) ** 2).sum()
    return beta, float(1 - ((y - x @ beta) ** 2).sum() / total) if total > 0 else float("nan")


def _corr(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.corrcoef(x, y)[0, 1]) if len(x) >= 3 and x.std() > 0 and y.std() > 0 else float("nan")


def qap_correlation(m1: np.ndarray, m2: np.ndarray, n_perm: int, stream: int) -> tuple[float, float]:
    """Correlation of two symmetric matrices over their common upper cells, and its p under relabelled nodes."""
    up = np.triu_indices(len(m1), 1)
    x = m1[up]

    def r(y):
        ok = np.isfinite(x) & np.isfinite(y)
        return _corr(x[ok], y[ok])

    seen = r(m2[up])
    if not np.isfinite(seen):
        return seen, float("nan")
    ge = 1
    for p in permutations(stream, np.arange(n_perm) * len(m1), len(m1)):
        ge += abs(r(m2[np.ix_(p, p)][up])) >= abs(seen) - TIE
    return seen, ge / (n_perm + 1)


def mrqap(y: np.ndarray, xs: list[np.ndarray], n_perm: int, stream: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients with the intercept first, R2, p of each): regression on matrices, y's nodes relabelled for p."""
    up = np.triu_indices(len(y), 1)
    x = np.column_stack([np.ones(len(up[0])), *[m[up] for m in xs]])

    def fit(v):
        ok = np.isfinite(v) & np.isfinite(x).all(axis=1)
        return _ols(v[ok], x[ok]) if ok.sum() > x.shape[1] else None

    seen = fit(y[up])
    if seen is None:
        nan = np.full(x.shape[1], np.nan)
        return nan, float("nan"), nan
    ge, n = np.ones(x.shape[1]), 1
    for p in permutations(stream, np.arange(n_perm) * len(y), len(y)):
        if (got := fit(y[np.ix_(p, p)][up])) is not None:
            ge += np.abs(got[0]) >= np.abs(seen[0]) - TIE
            n += 1
    return seen[0], seen[1], ge / n


PREDICTORS = ("pooled", "e00")


def _masked_corr(a: np.ndarray, b: np.ndarray, ok: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Correlation of each row's values where ok; NaN where a side does not vary."""
    a, b = (np.where(ok, v, 0.0) for v in (a, b))
    a, b = (np.where(ok, v - (v.sum(axis=1) / n)[:, None], 0.0) for v in (a, b))
    saa, sbb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((saa / n > 1e-18) & (sbb / n > 1e-18), (a * b).sum(axis=1) / np.sqrt(saa * sbb), np.nan)


def _pivotal_t(y: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """t of e in the regression of y on e and x (rows of values): from the correlation of y and e given x. NaN below 4 common cells."""
    ok = np.isfinite(y) & np.isfinite(e) & np.isfinite(x)
    n = np.maximum(ok.sum(axis=1), 1)
    ye, yx, ex = (_masked_corr(a, b, ok, n) for a, b in ((y, e), (y, x), (e, x)))
    with np.errstate(invalid="ignore", divide="ignore"):
        rest = (1 - yx * yx) * (1 - ex * ex)
        r = np.where(rest > 1e-18, (ye - yx * ex) / np.sqrt(rest), np.nan)
        return np.where((n > 3) & (np.abs(r) < 1 - 1e-12), r * np.sqrt(np.maximum(n - 3, 0) / (1 - r * r)), np.nan)


def partialled(y: np.ndarray, x: np.ndarray, other: np.ndarray, n_perm: int, stream: int) -> tuple[float, float, float]:
    """(coefficient, t, p) of x in the regression of matrix y on x and other, by double semi-partialling.

    x is replaced by its residual on the other regressor over the upper triangle; that matrix has its nodes relabelled, and the t of its
    coefficient, with the other regressor in the model, is compared with the observed one. Relabellings without a t do not count.
    """
    up = np.triu_indices(len(y), 1)
    ok = np.isfinite(y[up]) & np.isfinite(x[up]) & np.isfinite(other[up])
    residual = np.full(len(up[0]), np.nan)
    if ok.sum() > 3:
        residual[ok] = x[up][ok] - (design := np.column_stack([np.ones(ok.sum()), other[up][ok]])) @ _ols(x[up][ok], design)[0]
    e = np.full(y.shape, np.nan)
    e[up] = residual
    e.T[up] = residual
    t = _pivotal_t(y[up][None], residual[None], other[up][None])[0]
    if not np.isfinite(t):
        return float("nan"), float("nan"), float("nan")
    beta = float((y[up][ok] * residual[ok]).sum() / (residual[ok] ** 2).sum())
    ge = n = 1
    step = max(1, 2_000_000 // len(up[0]))
    for k in range(0, n_perm, step):
        p = permutations(stream, np.arange(k, min(n_perm, k + step)) * len(y), len(y))
        got = _pivotal_t(y[up][None], e[p[:, up[0]], p[:, up[1]]], other[up][None])
        n += int(np.isfinite(got).sum())
        ge += int((np.abs(got) >= abs(t) - 1e-9 * max(1.0, abs(t))).sum())
    return beta, float(t), ge / n


def qap_partialled(stats: DataFrame, n_perm: int = 199, min_nodes: int = 20, seed: int = 0, node_subsample: int | None = None) -> DataFrame:
    """window_id, regime, predictor, n_nodes, coef, t, p: s_odd on the pooled and e00 weights by double semi-partialling.

    Every window of enough members; a window and predictor is a task. Null where the pairs do not determine the coefficient.
    """
    p = qap_pairs(stats, node_subsample)
    size = p.select("window_id", F.explode(F.array("permno_a", "permno_b")).alias("v")).groupBy("window_id").agg(F.countDistinct("v").alias("n_nodes")).filter(F.col("n_nodes") >= min_nodes)
    p = p.join(F.broadcast(size), "window_id").withColumn("predictor", F.explode(F.array(*map(F.lit, PREDICTORS))))

    def run(key, f):
        window, name = key
        nodes = np.unique(f[["permno_a", "permno_b"]].to_numpy())
        i, j = (np.searchsorted(nodes, f[c]) for c in ("permno_a", "permno_b"))
        mats = {k: np.full((len(nodes), len(nodes)), np.nan) for k in ("s_odd", *PREDICTORS)}
        for k, m in mats.items():
            m[i, j] = m[j, i] = f[k].to_numpy(float)
        other = next(k for k in PREDICTORS if k != name)
        got = partialled(mats["s_odd"], mats[name], mats[other], n_perm, base("dsp", window, name, seed))
        return pd.DataFrame([(window, f["regime"].iloc[0], name, len(nodes), *[v if np.isfinite(v) else None for v in got])], columns=["window_id", "regime", "predictor", "n_nodes", "coef", "t", "p"])

    return p.groupBy("window_id", "predictor").applyInPandas(run, "window_id int, regime string, predictor string, n_nodes int, coef double, t double, p double")


_QAP = "r_pooled_e00 double, p_pooled_e00 double, r_pooled_s_odd double, p_pooled_s_odd double, r_e00_s_odd double, p_e00_s_odd double, gate_r2_s_odd_on_pooled_e00 double, gate_coef_e00 double, gate_p_e00 double"


def qap_hierarchy(stats: DataFrame, n_perm: int = 199, max_windows: int | None = 8, min_nodes: int = 20, seed: int = 0, node_subsample: int | None = None) -> DataFrame:
    """The three matrix correlations and the regression of s_odd, for the first windows of enough members (None: all)."""
    p = qap_pairs(stats, node_subsample)
    size = p.select("window_id", F.explode(F.array("permno_a", "permno_b")).alias("v")).groupBy("window_id").agg(F.countDistinct("v").alias("n_nodes")).filter(F.col("n_nodes") >= min_nodes)
    if max_windows:
        size = size.orderBy("window_id").limit(max_windows)
    p = p.join(F.broadcast(size), "window_id")

    def run(key, f):
        nodes = sorted(set(f["permno_a"]) | set(f["permno_b"]))
        at = {v: k for k, v in enumerate(nodes)}
        i, j = f["permno_a"].map(at).to_numpy(), f["permno_b"].map(at).to_numpy()
        mats = {}
        for k in ("pooled", "e00", "s_odd"):
            m = np.full((len(nodes), len(nodes)), np.nan)
            m[i, j] = m[j, i] = f[k].to_numpy(float)
            mats[k] = m
        out = []
        for a, b in (("pooled", "e00"), ("pooled", "s_odd"), ("e00", "s_odd")):
            out += qap_correlation(mats[a], mats[b], n_perm, base("qap", key[0], f"{a}_{b}", seed))
        beta, r2, pv = mrqap(mats["s_odd"], [mats["pooled"], mats["e00"]], n_perm, base("qap", key[0], "gate", seed))
        row = [key[0], f["regime"].iloc[0], len(nodes), *[None if not np.isfinite(v) else float(v) for v in (*out, r2, beta[2], pv[2])]]
        return pd.DataFrame([row], columns=["window_id", "regime", "n_nodes", *[c.split()[0] for c in _QAP.split(", ")]])

    return p.groupBy("window_id").applyInPandas(run, f"window_id int, regime string, n_nodes int, {_QAP}")


def gate_summary(real: DataFrame, null: DataFrame, reliability: DataFrame | None = None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """One row: means of both gates, the paired difference with a bootstrap interval, and the verdict."""
    gate = "gate_r2_s_odd_on_pooled_e00"
    means = real.agg(F.avg(gate).alias("real_gate_r2"), F.avg("r_e00_s_odd").alias("r_e00_s_odd_real")).crossJoin(F.broadcast(null.agg(F.avg(gate).alias("null_gate_r2"), F.avg("r_e00_s_odd").alias("r_e00_s_odd_null"))))
    sb = reliability.agg(F.avg("reliability_sb").alias("reliability_sb")) if reliability is not None else real.sparkSession.range(1).select(F.lit(None).cast("double").alias("reliability_sb"))
    d = real.select("window_id", F.col(gate).alias("r")).join(null.select("window_id", F.col(gate).alias("n")), "window_id").select((F.col("r") - F.col("n")).alias("d")).filter("d IS NOT NULL")
    packed = d.agg(F.array_sort(F.collect_list("d")).alias("d"))  # a value for each window of the gate

    def run(frames):
        for f in frames:
            v = np.asarray(f["d"].iloc[0], float)
            if not len(v):
                yield pd.DataFrame([(None, None, None, 0, "no baseline")], columns=["diff_real_minus_null", "diff_ci_lo", "diff_ci_hi", "n_gate_windows", "verdict"])
                continue
            chosen = np.floor(uniforms(base("boot", seed), np.arange(n_boot)[:, None] * len(v) + np.arange(len(v))) * len(v)).astype(int)
            boot = v[chosen].mean(axis=1)
            lo, hi = np.percentile(boot, [2.5, 97.5])
            verdict = "artifact" if lo <= 0 <= hi or v.mean() >= 0 else "residual structure"
            yield pd.DataFrame([(v.mean(), lo, hi, len(v), verdict)], columns=["diff_real_minus_null", "diff_ci_lo", "diff_ci_hi", "n_gate_windows", "verdict"])

    ci = packed.mapInPandas(run, "diff_real_minus_null double, diff_ci_lo double, diff_ci_hi double, n_gate_windows int, verdict string")
    return means.crossJoin(F.broadcast(sb)).crossJoin(F.broadcast(ci))


# Reliability of topology


def half_graphs(weights: DataFrame) -> dict[str, DataFrame]:
    """Weights of both halves as graphs, of windows with at least 10 common pairs."""
    keys = ["window_id", "permno_a", "permno_b"]
    common = weights.groupBy(*keys).agg(F.countDistinct("half").alias("h")).filter("h = 2")
    enough = common.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_common")).filter("n_common >= 10")
    w = weights.join(common.select(keys), keys, "left_semi").join(enough, "window_id")
    kinds = F.array(*[F.struct(F.lit(k).alias("graph"), F.col(f"w_{k}").alias("w")) for k in KINDS])
    w = w.select("window_id", "n_common", "half", F.col("permno_a").alias("src"), F.col("permno_b").alias("dst"), F.explode(kinds).alias("k")).select("window_id", "n_common", "half", "src", "dst", "k.graph", "k.w").filter("w IS NOT NULL")
    return {h: w.filter(F.col("half") == h).drop("half") for h in "ab"}


def half_jaccard(weights: DataFrame, share: float = 0.05) -> DataFrame:
    g = half_graphs(weights)
    return edge_jaccard(*(top_edges(g[h].drop("n_common"), share) for h in "ab")).withColumnRenamed("jaccard", "jaccard_topq")


def topology_reliability(weights: DataFrame, share: float = 0.05, metrics=METRICS) -> DataFrame:
    """Overlap of both halves' selected edges, and each half's topology."""
    g = half_graphs(weights)
    out = half_jaccard(weights, share)
    n = g["a"].groupBy("window_id", "graph").agg(F.max("n_common").alias("n_common"))
    out = out.join(n, ["window_id", "graph"])
    for h in "ab":
        marked = _marked(g[h].drop("n_common"), share, None)
        m = marked.groupBy("window_id", "graph", "threshold").applyInPandas(_metrics_of, f"window_id int, graph string, threshold string, {_METRIC_SCHEMA}")
        out = out.join(m.select("window_id", "graph", *[F.col(x).alias(f"{x}_{h}") for x in metrics]), ["window_id", "graph"])
    return out


def reliability_checkpoint(topology: DataFrame, reliability: DataFrame, metrics=METRICS) -> DataFrame:
    """One row for each graph: mean overlap, half-to-half correlations of the metrics, mean corrected edge reliability, and whether it clears the bar."""
    t = topology.groupBy("graph").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("jaccard_topq").alias("mean_jaccard_topq"), *[guarded_corr(f"{m}_a", f"{m}_b").alias(f"{m}_halfcorr") for m in metrics])
    cols = {"s_odd": "reliability_sb", "e00": "reliability_sb_e00", "pooled": "reliability_sb_pooled"}
    sb = reliability.agg(*[F.avg(c).alias(k) for k, c in cols.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("graph"), F.col(k).alias("mean_edge_sb_r")) for k in cols])).alias("x")).select("x.*")
    out = t.join(F.broadcast(sb), "graph", "left")
    clears = (F.coalesce("mean_edge_sb_r", F.lit(-1.0)) >= 0.3) | (F.coalesce("mean_jaccard_topq", F.lit(-1.0)) >= 0.2)
    if "modularity" in metrics:
        clears = clears | (F.coalesce("modularity_halfcorr", F.lit(-1.0)) >= 0.3)
    return out.withColumn("clears_bar", clears)


def metrics_by_regime(metrics: DataFrame, columns=METRICS) -> DataFrame:
    return metrics.groupBy("graph", "regime").agg(*[F.avg(m).alias(m) for m in columns], F.avg("edge_density").alias("edge_density"))


def metrics_by_type(metrics: DataFrame, columns=METRICS) -> DataFrame:
    """Mean metrics of windows by each of their episodes' types."""
    m = metrics.withColumn("crisis_type", F.explode(F.split("crisis_types", ";")))
    return m.groupBy("graph", "crisis_type").agg(F.count(F.lit(1)).alias("n_windows"), *[F.avg(x).alias(x) for x in columns])


def tier_summary(qap: DataFrame) -> DataFrame:
    """Mean and sample deviation over windows of the matrix correlations and the gate."""
    cols = ["r_pooled_e00", "r_pooled_s_odd", "r_e00_s_odd", "gate_r2_s_odd_on_pooled_e00"]
    return qap.agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols])


def tier_histogram(qap: DataFrame, bins: int = 10) -> DataFrame:
    """Each tier's matrix correlation over windows, in equal bins over its own range."""
    cols = ["r_pooled_e00", "r_pooled_s_odd", "r_e00_s_odd"]
    stacked = qap.select(F.explode(F.array(*[F.struct(F.lit(c).alias("tier"), F.col(c).alias("r")) for c in cols])).alias("x")).select("x.*").filter("r IS NOT NULL")
    span = stacked.groupBy("tier").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))  # a row for each tier
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("r") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))).cast("int")
    return stacked.join(F.broadcast(span), "tier").groupBy("tier", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))

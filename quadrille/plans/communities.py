"""DuckDB SQL for greedy communities and rewired graphs, and for what rests on them: merging and swapping as recursion.

The state of a graph is one row: its links between communities, their degrees and the members' communities, as lists. Every step of the
recursion merges the pair of the largest gain, or tries one swap with the numbers of that try.
"""

from __future__ import annotations

from .oracles import _HALVES, _NODES, _RELIABILITY, _W, _corr, _pairs, _r, _top
from .simulated import _base, _difference, _draws, _shape, _topology

_KEY = "window_id, graph, rep"
METRICS = ("modularity", "giant_frac", "avg_clustering")


def _communities(nodes: str, edges: str) -> str:
    """CTEs up to quality (modularity, n_communities) and member (node, community), for graphs told apart by _KEY (edges with w)."""
    gone = "CASE WHEN {c} = best.b THEN best.a ELSE {c} END"
    a, b = gone.format(c="z.a"), gone.format(c="z.b")
    return f"""num AS (SELECT {_KEY}, node, row_number() OVER (PARTITION BY {_KEY} ORDER BY node) AS i FROM {nodes}),
link2 AS (SELECT {_KEY}, least(s.i, d.i) AS a, greatest(s.i, d.i) AS b, CAST(w AS DOUBLE) AS w FROM {edges} JOIN (SELECT {_KEY}, node AS src, i FROM num) s USING ({_KEY}, src) JOIN (SELECT {_KEY}, node AS dst, i FROM num) d USING ({_KEY}, dst)),
degree2 AS (SELECT {_KEY}, i, coalesce(sum(w), 0.0) AS d FROM num LEFT JOIN (SELECT {_KEY}, a AS i, w FROM link2 UNION ALL SELECT {_KEY}, b, w FROM link2) USING ({_KEY}, i) GROUP BY {_KEY}, i),
begin AS (SELECT {_KEY}, m, lnk, deg, com FROM (SELECT {_KEY}, list(d ORDER BY i) AS deg, list(i ORDER BY i) AS com FROM degree2 GROUP BY {_KEY}) JOIN (SELECT {_KEY}, sum(w) AS m, list({{'a': a, 'b': b, 'w': w}} ORDER BY a, b) AS lnk FROM link2 GROUP BY {_KEY}) USING ({_KEY})),
merge AS (SELECT {_KEY}, m, lnk, deg, com, 0 AS step FROM begin UNION ALL
  SELECT {_KEY}, m, list_transform(list_distinct(list_transform(rel, lambda z: {{'a': z.a, 'b': z.b}})), lambda z: {{'a': z.a, 'b': z.b, 'w': list_sum(list_transform(list_filter(rel, lambda v: v.a = z.a AND v.b = z.b), lambda v: v.w))}}),
    list_transform(deg, lambda z, i: CASE WHEN i = best.a THEN z + deg[best.b] ELSE z END), list_transform(com, lambda z: {gone.format(c="z")}), step + 1
  FROM (SELECT *, list_filter(list_transform(lnk, lambda z: {{'a': least({a}, {b}), 'b': greatest({a}, {b}), 'w': z.w}}), lambda z: z.a <> z.b) AS rel
    FROM (SELECT *, list_sort(list_transform(lnk, lambda z: {{'g': round(deg[z.a] * deg[z.b] / (2 * m * m) - z.w / m, 12), 'a': z.a, 'b': z.b}}))[1] AS best FROM merge WHERE m <> 0 AND len(lnk) > 0) WHERE best.g < 0)),
final AS (SELECT * FROM merge QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY step DESC) = 1),
place AS (SELECT {_KEY}, i, c FROM (SELECT {_KEY}, unnest(com) AS c, generate_subscripts(com, 1) AS i FROM final)),
home AS (SELECT n.*, coalesce(c, i) AS c FROM num n LEFT JOIN place USING ({_KEY}, i)),
member AS (SELECT h.*, l.node AS community FROM home h JOIN (SELECT {_KEY}, i AS c, node FROM num) l USING ({_KEY}, c)),
inner2 AS (SELECT {_KEY}, x.c, sum(w) AS l FROM link2 JOIN (SELECT {_KEY}, i AS a, c FROM home) x USING ({_KEY}, a) JOIN (SELECT {_KEY}, i AS b, c FROM home) y USING ({_KEY}, b) WHERE x.c = y.c GROUP BY {_KEY}, x.c),
outer2 AS (SELECT {_KEY}, c, sum(d) AS k FROM degree2 JOIN home USING ({_KEY}, i) GROUP BY {_KEY}, c),
quality AS (SELECT {_KEY}, CASE WHEN max(m) IS NULL THEN 0.0 WHEN max(m) <> 0 THEN sum(coalesce(l, 0.0) / m - pow(k / (2 * m), 2)) END AS modularity, count(*) AS n_communities FROM outer2 LEFT JOIN begin USING ({_KEY}) LEFT JOIN inner2 USING ({_KEY}, c) GROUP BY {_KEY})"""


def _graphs(bound: bool = True) -> str:
    """CTEs up to gedge and gnode: the selected graphs, with rep -1."""
    more = " UNION ALL SELECT window_id, 's_odd_abs', -1, src, dst, w FROM w WHERE graph = 's_odd' AND w >= 2" if bound else ""
    lone = " UNION ALL SELECT window_id, 's_odd_abs', -1, node FROM nodes WHERE graph = 's_odd'" if bound else ""
    return f"gedge AS (SELECT window_id, graph, -1 AS rep, src, dst, w FROM top{more}), gnode AS (SELECT window_id, graph, -1 AS rep, node FROM nodes{lone})"


def _rewired(reps: int) -> str:
    """CTEs up to nedge and nnode: the rewirings that had swaps enough, by rep."""
    present = "list_transform(lnk, lambda z: {{'p': least(z.i, z.j), 'q': greatest(z.i, z.j)}})"
    pair = lambda p, q: f"{{'p': least({p}, {q}), 'q': greatest({p}, {q})}}"
    tried = f"x <> y AND a <> c AND a <> d AND b <> c AND b <> d AND NOT list_contains({present.format()}, {pair('a', 'd')}) AND NOT list_contains({present.format()}, {pair('c', 'b')})"
    return f"""swaps AS (SELECT window_id, graph, list({{'i': src, 'j': dst}} ORDER BY src, dst) AS lnk, count(*) AS m, (SELECT count(*) FROM nodes n WHERE n.window_id = t.window_id AND n.graph = t.graph) AS n FROM top t GROUP BY window_id, graph),
able AS (SELECT window_id, graph, rep, lnk, m, {_base("'rewire'", "window_id", "graph", "0", "rep")} AS base FROM swaps, (SELECT unnest(range({reps})) AS rep) WHERE n >= 4 AND m >= 2),
tries AS (SELECT {_KEY}, k, CAST(floor(max(u) FILTER (WHERE j = 0) * max(m)) AS BIGINT) + 1 AS x, CAST(floor(max(u) FILTER (WHERE j = 1) * max(m)) AS BIGINT) + 1 AS y, max(u) FILTER (WHERE j = 2) < 0.5 AS turn
  FROM {_draws("(SELECT window_id, graph, rep, m, base, k, unnest([0, 1, 2]) AS j FROM (SELECT *, unnest(generate_series(0, 10 * m - 1)) AS k FROM able))", "base", "3 * k + j")} GROUP BY {_KEY}, k),
turned AS (SELECT {_KEY}, lnk, m, 0 AS done, 0 AS k FROM able UNION ALL
  SELECT {_KEY}, CASE WHEN ok THEN list_transform(lnk, lambda z, i: CASE WHEN i = x THEN {{'i': a, 'j': d}} WHEN i = y THEN {{'i': c, 'j': b}} ELSE z END) ELSE lnk END, m, done + CAST(ok AS INT), k + 1
  FROM (SELECT *, {tried} AS ok FROM (SELECT r.*, x, y, lnk[x].i AS a, lnk[x].j AS b, CASE WHEN turn THEN lnk[y].j ELSE lnk[y].i END AS c, CASE WHEN turn THEN lnk[y].i ELSE lnk[y].j END AS d FROM turned r JOIN tries t USING (window_id, graph, rep, k) WHERE done < m))),
enough AS (SELECT {_KEY}, unnest(lnk) AS e FROM turned WHERE done = m),
nedge AS (SELECT x.window_id, x.graph, rep, x.src, x.dst, coalesce(t.w, 1.0) AS w FROM (SELECT {_KEY}, least(e.i, e.j) AS src, greatest(e.i, e.j) AS dst FROM enough) x LEFT JOIN top t ON t.window_id = x.window_id AND t.graph = x.graph AND t.src = x.src AND t.dst = x.dst),
nnode AS (SELECT n.window_id, n.graph, rep, node FROM nodes n JOIN (SELECT DISTINCT {_KEY} FROM enough) USING (window_id, graph))"""


def _half_graphs() -> str:
    """CTEs up to ht: overlap of both halves' selected edges and each half's topology, half a being rep 0."""
    kinds = " UNION ALL ".join(f"SELECT window_id, '{g}' AS graph, CAST(half = 'b' AS INT) AS rep, permno_a AS src, permno_b AS dst, w_{g} AS w FROM halves SEMI JOIN hn USING (window_id) WHERE w_{g} IS NOT NULL" for g in ("e00", "pooled", "s_odd"))
    return f"""{_HALVES.strip()}, hn AS (SELECT window_id, count(*) // 2 AS n_common FROM halves GROUP BY 1 HAVING count(*) >= 20), wh AS ({kinds}),
hsel AS (SELECT {_KEY}, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY abs(w) DESC, src, dst) AS r, count(*) OVER (PARTITION BY {_KEY}) AS n FROM wh) WHERE r <= greatest(1, CAST(round_even(0.05 * n, 0) AS INT))),
hnode AS (SELECT {_KEY}, src AS node FROM wh UNION SELECT {_KEY}, dst FROM wh), {_communities("hnode", "hsel")}, {_shape("hnode", "hsel", _KEY)},
hv AS (SELECT {_KEY}, modularity, giant_frac, avg_clustering FROM shape JOIN quality USING ({_KEY})),
both3 AS (SELECT window_id, graph, count(*) AS k FROM hsel GROUP BY window_id, graph, src, dst), jac AS (SELECT window_id, graph, CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) / count(*) AS jaccard_topq FROM both3 GROUP BY 1, 2),
ht AS (SELECT a.window_id, a.graph, jaccard_topq, n_common, {", ".join(f"{h}.{m} AS {m}_{h}" for h in "ab" for m in METRICS)} FROM hv a JOIN hv b ON b.window_id = a.window_id AND b.graph = a.graph AND b.rep = 1 JOIN jac ON jac.window_id = a.window_id AND jac.graph = a.graph JOIN hn ON hn.window_id = a.window_id WHERE a.rep = 0)"""


def _build() -> dict[str, str]:
    s = _pairs().strip()
    begin = f"WITH RECURSIVE {s}, "
    topo = f"{begin}{_topology()}, {_graphs()}, {_communities('gnode', 'gedge')}, net AS (SELECT t.*, q.modularity, q.n_communities FROM topo t JOIN quality q USING (window_id, graph))"
    body = f"SELECT window_id, graph, threshold, n_nodes, n_edges, {_r('edge_density', 'avg_clustering', 'giant_frac', 'modularity')}, CAST(n_communities AS INT) AS n_communities, win_start, regime, crisis_names, crisis_types FROM net"
    means = lambda columns: ", ".join(f"round(avg({m}), 9) + 0.0 AS {m}" for m in columns)
    null = f"""{begin}{_topology()}, {_rewired(20)}, every3 AS (SELECT * FROM nnode UNION ALL SELECT window_id, graph, -1, node FROM nodes), edge3 AS (SELECT * FROM nedge UNION ALL SELECT window_id, graph, -1, src, dst, w FROM top),
{_communities('every3', 'edge3')}, {_shape('every3', 'edge3', _KEY).replace('tri AS', 'tri3 AS').replace('FROM tri ', 'FROM tri3 ').replace('FROM tri)', 'FROM tri3)').replace('tcount', 'tcount3').replace('deg AS', 'deg3 AS').replace('JOIN deg ', 'JOIN deg3 ').replace('link AS', 'link3 AS').replace('JOIN link ', 'JOIN link3 ').replace('reach', 'reach3').replace('part AS', 'part3 AS').replace('FROM part ', 'FROM part3 ').replace('giant AS', 'giant3 AS').replace('JOIN giant ', 'JOIN giant3 ').replace('clus AS', 'clus3 AS').replace('FROM clus ', 'FROM clus3 ').replace('ecount', 'ecount3').replace('shape AS', 'shape3 AS')},
value AS (SELECT {_KEY}, modularity, CASE WHEN n_edges = 0 THEN 1.0 / n_nodes ELSE giant_frac END AS giant_frac, avg_clustering FROM shape3 JOIN quality USING ({_KEY})),
excess AS (SELECT r.window_id, r.graph, {", ".join(f"min(r.{m}) AS {m}, avg(n.{m}) AS {m}_null_mean, min(r.{m}) - avg(n.{m}) AS {m}_excess, (min(r.{m}) - avg(n.{m})) / nullif(stddev_samp(n.{m}), 0) AS {m}_z" for m in METRICS)}
  FROM value r LEFT JOIN value n ON n.window_id = r.window_id AND n.graph = r.graph AND n.rep >= 0 WHERE r.rep = -1 GROUP BY 1, 2),
conf AS (SELECT e.*, win_start, regime, crisis_names, crisis_types FROM excess e JOIN topo USING (window_id, graph))"""
    sides = [f"SELECT '{contrast}' AS contrast, '{m}' AS metric, {side} AS side, window_id, {m}_excess AS v FROM conf WHERE graph = 'e00' AND {cond}" for contrast, side, cond in (("crisis_vs_calm", 1, "regime = 'crisis'"), ("crisis_vs_calm", 2, "regime = 'calm'"), ("food_vs_financial", 1, "list_contains(string_split(crisis_types, ';'), 'food')"), ("food_vs_financial", 2, "list_contains(string_split(crisis_types, ';'), 'financial')")) for m in METRICS]
    rel = _RELIABILITY.replace("SELECT window_id, win_start", ", rel AS (SELECT window_id, win_start", 1) + ")"
    halfway = f"{begin}{_half_graphs()}"
    summary = f"""{rel.strip()}, sbr AS (SELECT 's_odd' AS graph, avg(reliability_sb) AS mean_edge_sb_r FROM rel UNION ALL SELECT 'e00', avg(reliability_sb_e00) FROM rel UNION ALL SELECT 'pooled', avg(reliability_sb_pooled) FROM rel),
cp AS (SELECT graph, count(*) AS n_windows, avg(jaccard_topq) AS mean_jaccard_topq, {', '.join(f'{_corr(f"{m}_a", f"{m}_b")} AS {m}_halfcorr' for m in METRICS)} FROM ht GROUP BY 1)"""
    bar = "coalesce(mean_edge_sb_r, -1) >= 0.3 OR coalesce(mean_jaccard_topq, -1) >= 0.2 OR coalesce(modularity_halfcorr, -1) >= 0.3 AS clears_bar"
    wide = [f"{m}{x}" for m in METRICS for x in ("", "_null_mean", "_excess")]
    return {
        "graph_communities": f"{begin}{_W}, {_top(0.05)}, {_NODES}, {_graphs(False)}, {_communities('gnode', 'gedge')} SELECT window_id, graph, node, community FROM member",
        "network_metrics": f"{topo} {body}",
        "metrics_over_time": f"{topo} {body}",
        "metrics_by_regime": f"{topo} SELECT graph, regime, {means((*METRICS, 'edge_density'))} FROM net GROUP BY 1, 2",
        "metrics_by_type": f"{topo} SELECT graph, crisis_type, count(*) AS n_windows, {means(METRICS)} FROM (SELECT *, unnest(string_split(crisis_types, ';')) AS crisis_type FROM net) GROUP BY 1, 2",
        "config_excess": f"{null} SELECT window_id, graph, {_r(*wide)}, {', '.join(f'round({m}_z, 9) + 0.0 AS {m}_z' for m in METRICS)}, win_start, regime, crisis_names, crisis_types FROM conf",
        "window_inference": f"{null}, {_difference(' UNION ALL '.join(sides)).replace('num AS', 'num4 AS').replace('FROM num)', 'FROM num4)')}",
        "topology_reliability": f"{halfway} SELECT window_id, graph, n_common, {_r('jaccard_topq', *[f'{m}_{h}' for h in 'ab' for m in METRICS])} FROM ht",
        "reliability_checkpoint": f"{halfway}, {summary} SELECT graph, n_windows, {_r('mean_jaccard_topq', *[f'{m}_halfcorr' for m in METRICS], 'mean_edge_sb_r')}, {bar} FROM cp LEFT JOIN sbr USING (graph)",
        "rewired_edges": f"{begin}{_W}, {_top(0.05)}, {_NODES}, {_rewired(1)} SELECT window_id, graph, src, dst, {_r('w')} FROM nedge",
    }


ORACLE_SQL: dict[str, str] = _build()

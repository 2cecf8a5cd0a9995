"""DuckDB SQL for simulations, permutations and topology: draws by the same arithmetic, everything else from the definitions."""

from __future__ import annotations

from ..operators.aggregates import BINS, edges_of
from ..operators.draws import MULTIPLIERS, STEP
from ..operators.sweep import RELAXED_QUANTILES
from .oracles import _EP, _HALVES, _NODES, _POOL, _RELIABILITY, _W, CELLS, _corr, _fit, _pairs, _r, _top
from .queries import N_MIN, N_MIN_LOW, SWEEP_NULL, TOPOLOGY

PAIR = "window_id, permno_a, permno_b"
_MASK = "4294967295::UBIGINT"


def _base(*keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT)"


def _draws(source: str, base: str, counter: str) -> str:
    """The source's columns with u, the stream's number at the counter."""
    return f"""(SELECT * EXCLUDE (s1, s2, s3), (CAST(xor(s3, s3 >> 16) AS DOUBLE) + 0.5) / 4294967296.0 AS u FROM (SELECT *, (xor(s2, s2 >> 13) * {MULTIPLIERS[1]}::UBIGINT) & {_MASK} AS s3
  FROM (SELECT *, (xor(s1, s1 >> 16) * {MULTIPLIERS[0]}::UBIGINT) & {_MASK} AS s2 FROM (SELECT *, CAST(({base} + CAST({counter} AS BIGINT) * {STEP}) & 4294967295 AS UBIGINT) AS s1 FROM {source}))))"""


def _cell_sums(source: str, keys: str) -> str:
    cols = []
    for c in CELLS:
        f = f"FILTER (WHERE x = {c[0]} AND y = {c[1]})"
        cols += [f"count(*) {f} AS N{c}", f"avg(a * b) {f} AS E{c}", f"avg(a) {f} AS a{c}", f"avg(b) {f} AS b{c}"]
    return f"SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}"


def _score(cells: str, n_min: int) -> str:
    """Cells with valid and the scores; raw scores (where no cell is empty) as s, d and c."""
    total = "(E00 + E01 + E10 + E11)"
    s = f"greatest({', '.join(f'abs({total} - 2 * E{c})' for c in CELLS)})"
    d = "(abs(a00 - a01) + abs(a10 - a11) + abs(b00 - b10) + abs(b01 - b11))"
    full = " AND ".join(f"N{c} > 0" for c in CELLS)
    return f"""SELECT *, CASE WHEN valid THEN s END AS s_odd, CASE WHEN valid THEN d END AS delta, CASE WHEN valid THEN s - d - 2 END AS ctx FROM (
  SELECT *, least({", ".join(f"N{c}" for c in CELLS)}) >= {n_min} AS valid, CASE WHEN {full} THEN {s} END AS s, CASE WHEN {full} THEN {d} END AS d FROM {cells})"""


def _null(source: str = "ok", n_min: int = N_MIN, q: float = 0.5, k: str = "") -> str:
    """CTEs up to nul{k}: one simulated run for each of the source's pairs."""
    pick = lambda v: "CASE " + " ".join(f"WHEN x = {c[0]} AND y = {c[1]} THEN {v}{c}" for c in CELLS) + " END"
    return f"""{_fit(source, n_min, q, k)},
days{k} AS (SELECT o.window_id, o.permno_a, o.permno_b, count(DISTINCT r.t) AS days FROM {source} o JOIN prow r ON r.window_id = o.window_id AND (r.permno = o.permno_a OR r.permno = o.permno_b) WHERE r.ret IS NOT NULL GROUP BY 1, 2, 3),
sim{k} AS (SELECT {PAIR}, day, {", ".join(f"max(u) FILTER (WHERE j = {j}) AS u{j}" for j in range(5))} FROM {_draws(f"(SELECT *, unnest([0, 1, 2, 3, 4]) AS j FROM (SELECT {PAIR}, {_base("'null'", "window_id", "permno_a", "permno_b", "0")} AS base, unnest(generate_series(0, days - 1)) AS day FROM fit{k} JOIN days{k} USING ({PAIR})))", "base", "day * 5 + j")} GROUP BY {PAIR}, day),
mag{k} AS (SELECT s.*, f.* EXCLUDE ({PAIR}), -greatest(CASE WHEN u0 >= 0.5 THEN scale_a1 ELSE scale_a0 END, 1e-12) * ln(u1) AS ma, -greatest(CASE WHEN u2 >= 0.5 THEN scale_b1 ELSE scale_b0 END, 1e-12) * ln(u3) AS mb FROM sim{k} s JOIN fit{k} f USING ({PAIR})),
thr{k} AS (SELECT {PAIR}, quantile_cont(ma, {q}) AS ta, quantile_cont(mb, {q}) AS tb FROM mag{k} GROUP BY {PAIR}),
reg{k} AS (SELECT m.*, CAST(ma < ta AS INT) AS x, CAST(mb < tb AS INT) AS y FROM mag{k} m JOIN thr{k} USING ({PAIR})),
chance{k} AS (SELECT {PAIR}, x, y, u4, {pick("pa")} AS pa, {pick("pb")} AS pb, {pick("rho")} AS rho FROM reg{k}),
joint{k} AS (SELECT *, pa * pb + rho * sqrt(pa * (1 - pa) * pb * (1 - pb)) AS pp FROM chance{k}),
prob{k} AS (SELECT *, greatest(pp, 0) AS p1, greatest(pa - pp, 0) AS p2, greatest(pb - pp, 0) AS p3, greatest(1 - pa - pb + pp, 0) AS p4 FROM joint{k}),
kind{k} AS (SELECT *, CAST(u4 >= p1 / (p1 + p2 + p3 + p4) AS INT) + CAST(u4 >= (p1 + p2) / (p1 + p2 + p3 + p4) AS INT) + CAST(u4 >= (p1 + p2 + p3) / (p1 + p2 + p3 + p4) AS INT) AS k FROM prob{k}),
run{k} AS (SELECT {PAIR}, x, y, CASE WHEN k < 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS a, CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS b FROM kind{k}),
nul{k} AS ({_score(f"({_cell_sums(f'run{k}', PAIR)})", n_min)})"""


_NULL_OUT = f"SELECT {PAIR}, regime, {_r(*[f'{v}{c}' for v in 'Eab' for c in CELLS])}, {', '.join(f'N{c}' for c in CELLS)}, {_r('s_odd', 'delta', 'ctx')}, valid, 'classical_null' AS source FROM nul JOIN lab USING (window_id)"


def _ctx_bins(source: str) -> str:
    e = edges_of(BINS["ctx"])
    rows = ", ".join(f"(CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), {'true' if k == len(e) - 2 else 'false'})" for k, (a, b) in enumerate(zip(e, e[1:], strict=False)))
    return f"SELECT 'ctx' AS var, {_r('bin_left', 'bin_right')}, count(n.ctx) AS count FROM (VALUES {rows}) AS e(bin_left, bin_right, last) LEFT JOIN (SELECT ctx FROM {source} WHERE valid) n ON n.ctx >= bin_left AND (n.ctx < bin_right OR (last AND n.ctx = bin_right)) GROUP BY e.bin_left, e.bin_right"


def _permuted(perms: int, width: int = 60) -> str:
    """CTEs up to shuf: for every valid pair and permutation, its joint days with the regimes of another joint day."""
    return f"""jd AS (SELECT o.window_id, o.permno_a, o.permno_b, l.t, l.x, r.x AS y, CAST(l.sg AS DOUBLE) AS a, CAST(r.sg AS DOUBLE) AS b, row_number() OVER (PARTITION BY o.window_id, o.permno_a, o.permno_b ORDER BY l.t) - 1 AS pos
  FROM ok o JOIN leg l ON l.window_id = o.window_id AND l.permno = o.permno_a AND l.sg <> 0 JOIN leg r ON r.window_id = o.window_id AND r.permno = o.permno_b AND r.t = l.t AND r.sg <> 0),
signs AS (SELECT row_number() OVER () AS pair, * FROM (SELECT {PAIR}, list(a ORDER BY pos) AS la, list(b ORDER BY pos) AS lb, {_base("'perm'", "window_id", "permno_a", "permno_b", "0")} AS base FROM jd GROUP BY {PAIR})),
days AS (SELECT pair, base, CAST(2 * x + y AS TINYINT) AS xy, CAST(pos AS TINYINT) AS pos FROM jd JOIN signs USING ({PAIR})),
nums AS (SELECT pair, CAST(perm AS SMALLINT) AS perm, xy, pos, u FROM {_draws(f"(SELECT *, unnest(generate_series(0, {perms - 1})) AS perm FROM days)", "base", f"perm * {width} + pos")}),
shuf AS (SELECT {PAIR}, perm, xy // 2 AS x, xy % 2 AS y, la[place] AS a, lb[place] AS b FROM (SELECT pair, perm, xy, row_number() OVER (PARTITION BY pair, perm ORDER BY u, pos) AS place FROM nums) JOIN signs USING (pair))"""


def _fair(source: str, keys: str) -> str:
    """Scores of fair signs: source has keys, base, first and the sizes N00 to N11; one number for each day, cell after cell."""
    ends = " ".join(f"WHEN day < {' + '.join(f'N{c}' for c in CELLS[: k + 1])} THEN {k}" for k in range(4))
    return f"""({_score(f'''({_cell_sums(f'''(SELECT {keys}, cell // 2 AS x, cell % 2 AS y, CASE WHEN floor(4 * u) < 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS a, CASE WHEN CAST(floor(4 * u) AS INT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS b
  FROM (SELECT *, CASE {ends} END AS cell FROM {_draws(f"(SELECT *, unnest(generate_series(0, N00 + N01 + N10 + N11 - 1)) AS day FROM {source})", "base", "first + day")}))''', keys)})''', 1)})"""


#: Sizes of the smallest cell of the valid pairs.
_SIZES = f"(SELECT DISTINCT CAST(least({', '.join(f'N{c}' for c in CELLS)}) AS INT) AS n FROM ok)"


def _runs(tag: str, sims: int) -> str:
    return f"""(SELECT n, sim, {_base(f"'{tag}'", "n", "0")} AS base, sim * 4 * n AS first, n AS N00, n AS N01, n AS N10, n AS N11 FROM {_SIZES}, (SELECT unnest(generate_series(0, {sims - 1})) AS sim))"""


def _topology() -> str:
    """CTEs up to topo, behind WITH RECURSIVE: density, clustering and giant component of the three graphs and the absolute one."""
    label = "CASE WHEN graph = 's_odd_abs' THEN '>=2' ELSE 'top-5%' END AS threshold"
    return f"""{_W}, {_top(0.05)},
sel AS (SELECT window_id, graph, src, dst FROM top UNION ALL SELECT window_id, 's_odd_abs', src, dst FROM w WHERE graph = 's_odd' AND w >= 2),
{_NODES}, every AS (SELECT * FROM nodes UNION ALL SELECT window_id, 's_odd_abs', node FROM nodes WHERE graph = 's_odd'),
{_shape("every", "sel", "window_id, graph")},
info AS (SELECT window_id, min(win_start) AS win_start, min(win_end) AS win_end, min(regime) AS regime FROM stats GROUP BY 1),
ep AS (SELECT * FROM (VALUES {_EP}) AS v(place, name, s, e, type)), hit AS (SELECT window_id, place, name, type FROM info LEFT JOIN ep ON win_start <= e AND win_end >= s),
tag AS (SELECT window_id, coalesce(string_agg(name, ';' ORDER BY place), 'none') AS crisis_names FROM hit GROUP BY 1),
typ AS (SELECT window_id, coalesce(string_agg(t, ';' ORDER BY t), 'none') AS crisis_types FROM (SELECT DISTINCT window_id, unnest(string_split(type, '/')) AS t FROM hit WHERE type IS NOT NULL) GROUP BY 1),
topo AS (SELECT s.window_id, s.graph, {label}, n_nodes, n_edges, edge_density, avg_clustering, giant_frac, win_start, regime, coalesce(crisis_names, 'none') AS crisis_names, coalesce(crisis_types, 'none') AS crisis_types
  FROM shape s JOIN info USING (window_id) LEFT JOIN tag USING (window_id) LEFT JOIN typ USING (window_id))"""


def _shape(nodes: str, edges: str, keys: str) -> str:
    """CTEs up to shape: the topology of every graph that the keys tell apart."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f"""tri AS (SELECT {of("x")}, x.src AS a, x.dst AS b, y.dst AS c FROM {edges} x JOIN {edges} y ON {on("x", "y")} AND x.dst = y.src JOIN {edges} z ON {on("x", "z")} AND z.src = x.src AND z.dst = y.dst),
tcount AS (SELECT {keys}, node, count(*) AS t FROM (SELECT {keys}, a AS node FROM tri UNION ALL SELECT {keys}, b FROM tri UNION ALL SELECT {keys}, c FROM tri) GROUP BY {keys}, node),
deg AS (SELECT {keys}, node, count(*) AS d FROM (SELECT {keys}, src AS node FROM {edges} UNION ALL SELECT {keys}, dst FROM {edges}) GROUP BY {keys}, node),
link AS (SELECT {keys}, src AS u, dst AS v FROM {edges} UNION SELECT {keys}, dst, src FROM {edges}),
reach AS (SELECT {keys}, node AS u, node AS v FROM {nodes} UNION SELECT {of("r")}, r.u, l.v FROM reach r JOIN link l ON {on("l", "r")} AND l.u = r.v),
part AS (SELECT {keys}, u, count(*) AS k FROM reach GROUP BY {keys}, u), giant AS (SELECT {keys}, CAST(max(k) AS DOUBLE) / count(*) AS giant_frac FROM part GROUP BY {keys}),
clus AS (SELECT {keys}, avg(coalesce(2.0 * t / nullif(d * (d - 1), 0), 0.0)) AS avg_clustering, CAST(count(*) AS INT) AS n_nodes FROM {nodes} LEFT JOIN deg USING ({keys}, node) LEFT JOIN tcount USING ({keys}, node) GROUP BY {keys}),
ecount AS (SELECT {keys}, CAST(count(*) AS INT) AS n_edges FROM {edges} GROUP BY {keys}),
shape AS (SELECT {keys}, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(2.0 * coalesce(n_edges, 0) / nullif(n_nodes * (n_nodes - 1), 0), 0.0) AS edge_density, avg_clustering, giant_frac FROM clus JOIN giant USING ({keys}) LEFT JOIN ecount USING ({keys}))"""


def _difference(source: str, n_perm: int = 20_000) -> str:
    """Permutation tests of vals (contrast, metric, side, window_id, v)."""
    return f"""vals AS ({source}), ord AS (SELECT *, row_number() OVER (PARTITION BY contrast, metric ORDER BY side, window_id) - 1 AS i, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY contrast, metric) AS na, count(*) OVER (PARTITION BY contrast, metric) AS n FROM vals WHERE v IS NOT NULL),
seen AS (SELECT contrast, metric, avg(v) FILTER (WHERE side = 1) AS m1, avg(v) FILTER (WHERE side = 2) AS m2, CAST(count(*) FILTER (WHERE side = 1) AS INT) AS n1, CAST(count(*) FILTER (WHERE side = 2) AS INT) AS n2 FROM ord GROUP BY 1, 2),
num AS {_draws(f"(SELECT *, {_base("'diff'", "contrast", "metric", "0")} AS base, unnest(generate_series(0, {n_perm - 1})) AS perm FROM ord)", "base", "perm * n + i")},
pos AS (SELECT *, row_number() OVER (PARTITION BY contrast, metric, perm ORDER BY u, i) - 1 AS place FROM num),
dif AS (SELECT contrast, metric, perm, avg(v) FILTER (WHERE place < na) - avg(v) FILTER (WHERE place >= na) AS d FROM pos GROUP BY 1, 2, 3),
far AS (SELECT contrast, metric, count(*) FILTER (WHERE abs(d) >= abs(m1 - m2) - 1e-12) AS k FROM dif JOIN seen USING (contrast, metric) GROUP BY 1, 2)
SELECT contrast, metric, 'e00' AS graph, round(m1, 9) + 0.0 AS mean_group1, round(m2, 9) + 0.0 AS mean_group2, n1 AS n_group1, n2 AS n_group2, CASE WHEN n1 >= 2 AND n2 >= 2 THEN round(m1 - m2, 9) + 0.0 END AS diff, CASE WHEN n1 >= 2 AND n2 >= 2 THEN round((1 + k) / {n_perm + 1}.0, 9) + 0.0 END AS perm_p FROM seen LEFT JOIN far USING (contrast, metric)"""


_TIERS = (("pooled", "e00"), ("pooled", "s_odd"), ("e00", "s_odd"))


def _qap(source: str = "ok", n_perm: int = 199, k: str = "") -> str:
    """CTEs up to qap{k}: matrix correlations and the regression of s_odd for every window of 5 members, with their permutations."""
    ols = lambda y: f"(regr_count({y}, pooled) * 0 + (covar_pop({y}, e00) * var_pop(pooled) - covar_pop({y}, pooled) * covar_pop(pooled, e00)) / (var_pop(pooled) * var_pop(e00) - pow(covar_pop(pooled, e00), 2)))"
    pooled = lambda y: f"((covar_pop({y}, pooled) * var_pop(e00) - covar_pop({y}, e00) * covar_pop(pooled, e00)) / (var_pop(pooled) * var_pop(e00) - pow(covar_pop(pooled, e00), 2)))"
    tests = ", ".join(f"'{a}_{b}'" for a, b in _TIERS)
    observed = ", ".join(f"{_corr(a, b)} AS r_{a}_{b}" for a, b in _TIERS)
    moved = {"pooled_e00": ("x.pooled", "v.e00"), "pooled_s_odd": ("x.pooled", "v.s_odd"), "e00_s_odd": ("x.e00", "v.s_odd")}
    case = lambda j: "CASE a.test " + " ".join(f"WHEN '{t}' THEN {ab[j]}" for t, ab in moved.items()) + " END"
    return f"""m{k} AS (SELECT window_id, regime, permno_a, permno_b, {_POOL} AS pooled, E00 AS e00, s_odd FROM {source}),
node{k} AS (SELECT window_id, p, row_number() OVER (PARTITION BY window_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY window_id) AS n FROM (SELECT window_id, permno_a AS p FROM m{k} UNION SELECT window_id, permno_b FROM m{k})),
big{k} AS (SELECT window_id, CAST(max(n) AS INT) AS n_nodes FROM node{k} GROUP BY 1 HAVING max(n) >= 5),
o{k} AS (SELECT window_id, min(regime) AS regime, {observed}, {ols("s_odd")} AS be, {pooled("s_odd")} AS bp, avg(s_odd) AS ms, avg(pooled) AS mp, avg(e00) AS me FROM m{k} SEMI JOIN big{k} USING (window_id) GROUP BY 1),
r2{k} AS (SELECT window_id, 1 - sum(pow(s_odd - ms - bp * (pooled - mp) - be * (e00 - me), 2)) / sum(pow(s_odd - ms, 2)) AS r2 FROM m{k} JOIN o{k} USING (window_id) GROUP BY 1),
turn{k} AS (SELECT window_id, test, perm, p, row_number() OVER (PARTITION BY window_id, test, perm ORDER BY u, i) - 1 AS place
  FROM {_draws(f"(SELECT node{k}.*, test, {_base("'qap'", "window_id", "test", "0")} AS base, unnest(generate_series(0, {n_perm - 1})) AS perm FROM node{k} SEMI JOIN big{k} USING (window_id), (SELECT unnest([{tests}, 'gate']) AS test))", "base", "perm * n + i")}),
swap{k} AS (SELECT t.window_id, t.test, t.perm, s.p AS old, t.p AS new FROM turn{k} t JOIN node{k} s ON s.window_id = t.window_id AND s.i = t.place),
crossed{k} AS (SELECT x.window_id, a.test, a.perm, {case(0)} AS p, {case(1)} AS q, x.pooled, x.e00, v.s_odd FROM m{k} x JOIN swap{k} a ON a.window_id = x.window_id AND a.old = x.permno_a JOIN swap{k} b ON b.window_id = x.window_id AND b.test = a.test AND b.perm = a.perm AND b.old = x.permno_b
  JOIN m{k} v ON v.window_id = x.window_id AND v.permno_a = least(a.new, b.new) AND v.permno_b = greatest(a.new, b.new)),
moved{k} AS (SELECT window_id, test, perm, CASE WHEN test <> 'gate' THEN {_corr("p", "q")} END AS r, CASE WHEN test = 'gate' AND count(*) > 3 THEN {ols("s_odd")} END AS be FROM crossed{k} GROUP BY 1, 2, 3),
pv{k} AS (SELECT window_id, {", ".join(f"(1 + count(*) FILTER (WHERE test = '{a}_{b}' AND abs(r) >= abs(r_{a}_{b}) - 1e-12)) / {n_perm + 1}.0 AS p_{a}_{b}" for a, b in _TIERS)},
  (1 + count(*) FILTER (WHERE test = 'gate' AND abs(moved{k}.be) >= abs(o{k}.be) - 1e-12)) / (1.0 + count(*) FILTER (WHERE test = 'gate' AND moved{k}.be IS NOT NULL)) AS pg FROM moved{k} JOIN o{k} USING (window_id) GROUP BY 1),
qap{k} AS (SELECT window_id, regime, n_nodes, {", ".join(f"r_{a}_{b}, CASE WHEN r_{a}_{b} IS NOT NULL THEN p_{a}_{b} END AS p_{a}_{b}" for a, b in _TIERS)}, r2 AS gate_r2_s_odd_on_pooled_e00, be AS gate_coef_e00, pg AS gate_p_e00 FROM o{k} JOIN big{k} USING (window_id) JOIN r2{k} USING (window_id) JOIN pv{k} USING (window_id))"""


_QAP_COLS = [*[f"{v}_{a}_{b}" for a, b in _TIERS for v in "rp"], "gate_r2_s_odd_on_pooled_e00", "gate_coef_e00", "gate_p_e00"]
_GATE = "gate_r2_s_odd_on_pooled_e00"


def _sweep_null(quantiles) -> str:
    """Rates of the null at the swept quantiles, from the pairs that are valid there."""
    ctes = []
    out = []
    for i, q in enumerate(quantiles):
        k = f"_{i}"
        full = _pairs(n_min=N_MIN_LOW, q=q)
        tail = full[full.index("theta AS (") :]
        for name in ("theta", "leg", "skel", "cells", "scored", "stats", "ok"):
            tail = tail.replace(f"{name} AS (", f"{name}{k} AS (").replace(f"FROM {name} ", f"FROM {name}{k} ").replace(f"JOIN {name} ", f"JOIN {name}{k} ").replace(f"FROM {name})", f"FROM {name}{k})")
        chosen = f"""pick{k} AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', CAST(regime AS VARCHAR), CAST(window_id AS VARCHAR), CAST(permno_a AS VARCHAR), CAST(permno_b AS VARCHAR), '0')), window_id, permno_a, permno_b) AS place FROM ok{k}) WHERE place <= 3000)"""
        ctes += [tail, chosen, _null(f"pick{k}", N_MIN_LOW, q, k)]
        out.append(f"SELECT regime, round(avg(CASE WHEN valid THEN CASE WHEN ctx > 0 THEN 1.0 ELSE 0.0 END END), 9) + 0.0 AS cbd_rate_null_relaxed, count(*) FILTER (WHERE valid) AS n_valid_null_relaxed, CAST({q} AS DOUBLE) AS theta_q FROM nul{k} JOIN lab USING (window_id) GROUP BY regime")
    head = _pairs()
    return f"WITH {head[: head.index('theta AS (')]} {', '.join(ctes)} {' UNION ALL '.join(out)}"


def _build() -> dict[str, str]:
    s, low = _pairs(), _pairs(n_min=N_MIN_LOW)
    with_ = lambda ctes, body: f"WITH {s}, {ctes} {body}"
    reach = lambda ctes, body: f"WITH RECURSIVE {s.strip()}, {ctes} {body}"
    sample = "(SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY md5(concat_ws('|', CAST(window_id AS VARCHAR), CAST(permno_a AS VARCHAR), CAST(permno_b AS VARCHAR), '0')), permno_a, permno_b) AS place FROM ok)"
    six = "six AS (SELECT DISTINCT window_id FROM ok ORDER BY 1 LIMIT 6), ends AS (SELECT window_id, permno_a AS p FROM ok UNION SELECT window_id, permno_b FROM ok), kept AS (SELECT window_id, p FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY p) AS r FROM ends SEMI JOIN six USING (window_id)) WHERE r <= 60), pick AS (SELECT o.* FROM ok o JOIN kept a ON a.window_id = o.window_id AND a.p = o.permno_a JOIN kept b ON b.window_id = o.window_id AND b.p = o.permno_b)"
    top = _topology()
    sides = []
    for contrast, side, cond in (("crisis_vs_calm", 1, "regime = 'crisis'"), ("crisis_vs_calm", 2, "regime = 'calm'"), ("food_vs_financial", 1, "list_contains(string_split(crisis_types, ';'), 'food')"), ("food_vs_financial", 2, "list_contains(string_split(crisis_types, ';'), 'financial')")):
        sides += [f"SELECT '{contrast}' AS contrast, '{m}' AS metric, {side} AS side, window_id, {m} AS v FROM topo WHERE graph = 'e00' AND {cond}" for m in TOPOLOGY]
    halves = f"""{_HALVES.strip()}, hn AS (SELECT window_id, count(*) // 2 AS n_common FROM halves GROUP BY 1 HAVING count(*) >= 20),
wh AS ({" UNION ALL ".join(f"SELECT window_id, '{g}' AS graph, half, permno_a AS src, permno_b AS dst, w_{g} AS w FROM halves SEMI JOIN hn USING (window_id) WHERE w_{g} IS NOT NULL" for g in ("e00", "pooled", "s_odd"))}),
hsel AS (SELECT window_id, graph, half, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY window_id, graph, half ORDER BY abs(w) DESC, src, dst) AS r, count(*) OVER (PARTITION BY window_id, graph, half) AS n FROM wh) WHERE r <= greatest(1, CAST(round_even(0.05 * n, 0) AS INT))),
hnode AS (SELECT window_id, graph, half, src AS node FROM wh UNION SELECT window_id, graph, half, dst FROM wh),
{_shape("hnode", "hsel", "window_id, graph, half")},
bothh AS (SELECT window_id, graph, count(*) AS k FROM hsel GROUP BY window_id, graph, src, dst), jac AS (SELECT window_id, graph, CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) / count(*) AS jaccard_topq FROM bothh GROUP BY 1, 2),
ht AS (SELECT a.window_id, a.graph, jaccard_topq, n_common, {", ".join(f"{h}.{m} AS {m}_{h}" for h in "ab" for m in TOPOLOGY)} FROM shape a JOIN shape b ON b.window_id = a.window_id AND b.graph = a.graph AND b.half = 'b' JOIN jac ON jac.window_id = a.window_id AND jac.graph = a.graph JOIN hn ON hn.window_id = a.window_id WHERE a.half = 'a')"""
    rel = _RELIABILITY.replace("SELECT window_id, win_start", ", rel AS (SELECT window_id, win_start", 1) + ")"
    hist = _ctx_bins("nul")
    qap_null = f"{_qap()}, {_null()}, gate AS (SELECT nul.*, regime FROM nul JOIN lab USING (window_id) WHERE valid), {_qap('gate', k='_n')}"
    boot = f"""gd AS (SELECT r.{_GATE} - n.{_GATE} AS d FROM qap r JOIN qap_n n USING (window_id) WHERE r.{_GATE} - n.{_GATE} IS NOT NULL), gl AS (SELECT list(d ORDER BY d) AS l, count(*) AS n FROM gd),
gb AS (SELECT b, avg(l[CAST(floor(u * n) AS BIGINT) + 1]) AS m FROM {_draws(f"(SELECT l, n, b, {_base("'boot'", "0")} AS base, unnest(generate_series(0, n - 1)) AS j FROM gl, (SELECT unnest(generate_series(0, 1999)) AS b))", "base", "b * n + j")} GROUP BY b),
gq AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM gb), gm AS (SELECT avg(d) AS d, count(*) AS n FROM gd), {rel.strip()}
SELECT (SELECT round(avg({_GATE}), 9) + 0.0 FROM qap) AS real_gate_r2, (SELECT round(avg(r_e00_s_odd), 9) + 0.0 FROM qap) AS r_e00_s_odd_real, (SELECT round(avg({_GATE}), 9) + 0.0 FROM qap_n) AS null_gate_r2, (SELECT round(avg(r_e00_s_odd), 9) + 0.0 FROM qap_n) AS r_e00_s_odd_null,
  (SELECT round(avg(reliability_sb), 9) + 0.0 FROM rel) AS reliability_sb, round(d, 9) + 0.0 AS diff_real_minus_null, round(lo, 9) + 0.0 AS diff_ci_lo, round(hi, 9) + 0.0 AS diff_ci_hi, CAST(n AS INT) AS n_gate_windows, CASE WHEN (lo <= 0 AND hi >= 0) OR d >= 0 THEN 'artifact' ELSE 'residual structure' END AS verdict FROM gm, gq"""
    fair_many = _fair(_runs("small", 2000), "n, sim")
    return {
        "streamed_totals": "SELECT user_id AS key, CAST(date_trunc('day', ts) AS DATE) AS period, round(sum(CAST(value AS DOUBLE)), 4) + 0.0 AS total, count(*) AS n FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
        "classical_null": with_(_null(), _NULL_OUT),
        "classical_null_hist": with_(_null(), hist),
        "streamed_null_hist": with_(f"pick AS (SELECT * EXCLUDE (place) FROM {sample} WHERE place <= 400), {_null('pick')}", hist),
        "null_gate_stats": with_(f"{six}, {_null('pick')}", _NULL_OUT),
        "ctx_null_overlay": with_(
            f"{_null()}, v AS (SELECT 'empirical' AS source, ctx AS v FROM ok WHERE ctx IS NOT NULL UNION ALL SELECT 'classical_null', ctx FROM nul WHERE valid AND ctx IS NOT NULL), sp AS (SELECT least(min(v), -2.0) AS lo, greatest(max(v), 1.0) AS hi FROM v WHERE source = 'empirical'), c AS (SELECT source, lo, hi, CAST(least(58, floor((v - lo) / ((hi - lo) / 59))) AS INT) AS bin, count(*) AS k FROM v, sp WHERE v BETWEEN lo AND hi GROUP BY 1, 2, 3, 4)",
            f"SELECT source, bin, {_r('lo', 'hi')}, k AS count, round(k / (sum(k) OVER (PARTITION BY source) * ((hi - lo) / 59)), 9) + 0.0 AS density FROM c",
        ),
        "placebo": with_(_permuted(2), f"SELECT {PAIR}, CAST(perm AS INT) AS perm, {', '.join(f'N{c}' for c in CELLS)}, {_r('s_odd', 'delta', 'ctx')}, valid FROM ({_score(f'({_cell_sums("shuf", f"{PAIR}, perm")})', N_MIN)})"),
        "max_stat_null": with_(
            f"{_permuted(200)}, ps AS ({_score(f'({_cell_sums("shuf", f"{PAIR}, perm")})', 1)}), best AS (SELECT window_id, perm, max(s - d - 2) AS m FROM ps GROUP BY 1, 2 HAVING max(s - d - 2) IS NOT NULL), bar AS (SELECT window_id, quantile_cont(m, 0.95) AS ctx_threshold FROM best GROUP BY 1), ob AS (SELECT window_id, count(*) AS n_pairs, max(ctx) AS max_observed FROM ok GROUP BY 1)",
            f"SELECT window_id, n_pairs, {_r('ctx_threshold', 'max_observed')} FROM ob JOIN bar USING (window_id)",
        ),
        "small_sample_null": f"WITH {low} SELECT CAST(n AS INT) AS N, round(avg(s), 9) + 0.0 AS s_odd_mean, round(quantile_cont(s, 0.95), 9) + 0.0 AS s_odd_q95, round(avg(s) - 2, 9) + 0.0 AS ctx_mean, round(avg(CASE WHEN s > 2 + 1e-9 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS frac_sodd_gt2 FROM {fair_many} GROUP BY n",
        "finite_n_floor": f"WITH {low} SELECT n AS n_min, round(avg(CASE WHEN s - d - 2 > 1e-9 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS floor FROM {_fair(_runs('floor', 8000), 'n, sim')} GROUP BY n",
        "matched_floor": f"WITH {low}, pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', regime, CAST(window_id AS VARCHAR), CAST(permno_a AS VARCHAR), CAST(permno_b AS VARCHAR), '0')), window_id, permno_a, permno_b) AS place FROM ok) WHERE place <= 5000), src AS (SELECT regime, {PAIR}, {_base("'matched'", 'window_id', 'permno_a', 'permno_b', '0')} AS base, 0 AS first, {', '.join(f'greatest(1, N{c}) AS N{c}' for c in CELLS)} FROM pick) SELECT regime, round(avg(CASE WHEN s - d - 2 > 1e-9 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS floor FROM {_fair('src', f'regime, {PAIR}')} GROUP BY regime",
        "sweep_null_rates": _sweep_null(RELAXED_QUANTILES),
        "sweep_null_rates_q70": _sweep_null(SWEEP_NULL),
        "qap_permutation": with_(_qap(), f"SELECT window_id, regime, n_nodes, {_r(*_QAP_COLS)} FROM qap"),
        "qap_first_windows": with_(
            f"ends AS (SELECT window_id, permno_a AS p FROM ok UNION SELECT window_id, permno_b FROM ok), kept AS (SELECT window_id, p FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY p) AS r FROM ends) WHERE r <= 12), pick AS (SELECT o.* FROM ok o JOIN kept a ON a.window_id = o.window_id AND a.p = o.permno_a JOIN kept b ON b.window_id = o.window_id AND b.p = o.permno_b), {_qap('pick', 1)}",
            f"SELECT window_id, regime, n_nodes, {_r('r_pooled_e00', 'r_pooled_s_odd', 'r_e00_s_odd', _GATE, 'gate_coef_e00')} FROM qap ORDER BY window_id LIMIT 8",
        ),
        "tier_summary": with_(_qap(), "SELECT " + ", ".join(f"round(avg({c}), 9) + 0.0 AS {c}_mean, round(stddev_samp({c}), 9) + 0.0 AS {c}_sd" for c in ("r_pooled_e00", "r_pooled_s_odd", "r_e00_s_odd", _GATE)) + " FROM qap"),
        "tier_histogram": with_(
            f"{_qap()}, ti AS ({' UNION ALL '.join(f"SELECT 'r_{a}_{b}' AS tier, r_{a}_{b} AS r FROM qap WHERE r_{a}_{b} IS NOT NULL" for a, b in _TIERS)}), sp AS (SELECT tier, min(r) AS lo, max(r) AS hi FROM ti GROUP BY 1)",
            f"SELECT tier, {_r('lo', 'hi')}, CAST(least(9, coalesce(floor((r - lo) / nullif(hi - lo, 0) * 10), 0)) AS INT) AS bin, count(*) AS count FROM ti JOIN sp USING (tier) GROUP BY 1, sp.lo, sp.hi, 4",
        ),
        "gate_summary": with_(f"{qap_null}, {_HALVES.strip()}", f", {boot}"),
        "rewired_degrees": with_(f"{_W}, {_top(0.05)}, {_NODES}, d AS (SELECT window_id, graph, v AS node, count(*) AS k FROM (SELECT window_id, graph, src AS v FROM top UNION ALL SELECT window_id, graph, dst FROM top) GROUP BY 1, 2, 3)", "SELECT window_id, graph, node, CAST(coalesce(k, 0) AS INT) AS degree FROM nodes LEFT JOIN d USING (window_id, graph, node)"),
        "network_topology": reach(top, f"SELECT window_id, graph, threshold, n_nodes, n_edges, {_r('edge_density', 'avg_clustering', 'giant_frac')}, win_start, regime, crisis_names, crisis_types FROM topo"),
        "topology_over_time": reach(top, f"SELECT graph, win_start, {_r(*TOPOLOGY)} FROM topo"),
        "topology_by_regime": reach(top, f"SELECT graph, regime, {', '.join(f'round(avg({m}), 9) + 0.0 AS {m}' for m in (*TOPOLOGY, 'edge_density'))} FROM topo GROUP BY 1, 2"),
        "topology_by_type": reach(top, f"SELECT graph, crisis_type, count(*) AS n_windows, {', '.join(f'round(avg({m}), 9) + 0.0 AS {m}' for m in TOPOLOGY)} FROM (SELECT *, unnest(string_split(crisis_types, ';')) AS crisis_type FROM topo) GROUP BY 1, 2"),
        "topology_inference": reach(top + ", " + _difference(" UNION ALL ".join(sides)), ""),
        "half_topology": reach(halves, f"SELECT window_id, graph, n_common, {_r('jaccard_topq', *[f'{m}_{h}' for h in 'ab' for m in TOPOLOGY])} FROM ht"),
        "half_topology_checkpoint": reach(
            f"{halves}, {rel.strip()}, sbr AS (SELECT 's_odd' AS graph, avg(reliability_sb) AS mean_edge_sb_r FROM rel UNION ALL SELECT 'e00', avg(reliability_sb_e00) FROM rel UNION ALL SELECT 'pooled', avg(reliability_sb_pooled) FROM rel), cp AS (SELECT graph, count(*) AS n_windows, avg(jaccard_topq) AS mean_jaccard_topq, {', '.join(f'{_corr(f"{m}_a", f"{m}_b")} AS {m}_halfcorr' for m in TOPOLOGY)} FROM ht GROUP BY 1)",
            f"SELECT graph, n_windows, {_r('mean_jaccard_topq', *[f'{m}_halfcorr' for m in TOPOLOGY], 'mean_edge_sb_r')}, coalesce(mean_edge_sb_r, -1) >= 0.3 OR coalesce(mean_jaccard_topq, -1) >= 0.2 AS clears_bar FROM cp LEFT JOIN sbr USING (graph)",
        ),
    }


ORACLE_SQL: dict[str, str] = _build()

"""DuckDB SQL that gives the same rows as the queries, written from the definitions, day by day instead of by bitmask."""

from __future__ import annotations

from ..operators.aggregates import BINS, edges_of
from ..operators.labels import EPISODES, RECESSIONS
from ..operators.sweep import QUANTILES
from .queries import N_MIN, N_MIN_LOW, STEP, WIDTH

CELLS = ("00", "01", "10", "11")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _panel(w: int = WIDTH) -> str:
    return f"""
brandrev AS (SELECT CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS INT) AS permno, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS "date",
  CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS rev
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
panel AS (SELECT permno, "date", rev / lag(rev) OVER (PARTITION BY permno ORDER BY "date") - 1 AS ret FROM brandrev),
cal AS (SELECT "date", row_number() OVER (ORDER BY "date") - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT "date" FROM panel)),
wins AS (SELECT CAST(unnest(generate_series(0, (SELECT CAST(floor((max(n) - {w}) / {STEP}.0) AS BIGINT) FROM cal))) AS INT) AS window_id),
wcal AS (SELECT window_id, "date", i - window_id * {STEP} AS t FROM cal JOIN wins ON i >= window_id * {STEP} AND i < window_id * {STEP} + {w}),
bounds AS (SELECT window_id, min("date") AS win_start, max("date") AS win_end FROM wcal GROUP BY 1),
span AS (SELECT min("date") AS lo, max("date") AS hi FROM panel),
memb AS (SELECT permno, CAST(CASE WHEN permno % 7 = 0 THEN lo + 420 ELSE lo END AS DATE) AS mbrstartdt, CAST(CASE WHEN permno % 5 = 0 THEN hi - 420 ELSE hi END AS DATE) AS mbrenddt
  FROM (SELECT DISTINCT permno FROM panel), span
  UNION ALL SELECT permno, CAST(lo + 140 AS DATE), hi FROM (SELECT DISTINCT permno FROM panel), span WHERE permno % 11 = 0),
cover AS (SELECT window_id, permno, count(DISTINCT "date") AS d FROM memb JOIN wcal ON "date" BETWEEN mbrstartdt AND mbrenddt GROUP BY 1, 2),
elig AS (SELECT window_id, permno FROM cover WHERE d >= {w}),
prow AS (SELECT e.window_id, e.permno, c."date", c.t, p.ret FROM elig e JOIN wcal c ON c.window_id = e.window_id JOIN panel p ON p.permno = e.permno AND p."date" = c."date"),
recess AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in RECESSIONS)}) AS v(s, e)),
lab AS (SELECT window_id, CASE WHEN EXISTS (SELECT 1 FROM recess WHERE win_start <= e AND win_end >= s) THEN 'crisis' ELSE 'calm' END AS regime FROM bounds),
vix AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS "date", CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0 AS vix FROM orders GROUP BY 1),
sect AS (SELECT DISTINCT permno, 'S' || CAST(permno // 10 AS VARCHAR) AS sector FROM panel)"""


def _cells(leg: str, keys: str = "window_id, permno_a, permno_b") -> str:
    cols = []
    for c in CELLS:
        f = f"FILTER (WHERE x = {c[0]} AND y = {c[1]})"
        cols += [f"count(*) {f} AS N{c}", f"avg(a * b) {f} AS E{c}", f"avg(a) {f} AS a{c}", f"avg(b) {f} AS b{c}"]
    return f"""SELECT {keys}, {", ".join(cols)} FROM (
  SELECT l.window_id, l.permno AS permno_a, r.permno AS permno_b, l.x, r.x AS y, CAST(l.sg AS DOUBLE) AS a, CAST(r.sg AS DOUBLE) AS b
  FROM {leg} l JOIN {leg} r ON l.window_id = r.window_id AND l.t = r.t AND l.permno < r.permno WHERE l.sg <> 0 AND r.sg <> 0) GROUP BY {keys}"""


def _scores(cells: str, skel: str, n_min: int) -> str:
    total = "(E00 + E01 + E10 + E11)"
    s = f"greatest({', '.join(f'abs({total} - 2 * E{c})' for c in CELLS)})"
    d = "abs(a00 - a01) + abs(a10 - a11) + abs(b00 - b10) + abs(b01 - b11)"
    return f"""SELECT *, CASE WHEN valid THEN {s} END AS s_odd, CASE WHEN valid THEN {d} END AS delta, CASE WHEN valid THEN {s} - ({d}) - 2 END AS ctx FROM (
  SELECT k.window_id, k.permno_a, k.permno_b, {", ".join(f"coalesce(N{c}, 0) AS N{c}" for c in CELLS)}, {", ".join(f"{v}{c}" for v in "Eab" for c in CELLS)},
    least({", ".join(f"coalesce(N{c}, 0)" for c in CELLS)}) >= {n_min} AS valid
  FROM {skel} k LEFT JOIN {cells} c ON c.window_id = k.window_id AND c.permno_a = k.permno_a AND c.permno_b = k.permno_b)"""


_SKEL = "SELECT l.window_id, l.permno AS permno_a, r.permno AS permno_b FROM theta l JOIN theta r ON l.window_id = r.window_id AND l.permno < r.permno"


def _pairs(w: int = WIDTH, n_min: int = N_MIN, q: float = 0.5) -> str:
    return f"""{_panel(w)},
theta AS (SELECT window_id, permno, quantile_cont(abs(ret), {q}) AS theta FROM prow WHERE ret IS NOT NULL GROUP BY 1, 2),
leg AS (SELECT r.window_id, r.permno, r.t, r."date", r.ret, CASE WHEN abs(r.ret) >= h.theta THEN 0 ELSE 1 END AS x, sign(r.ret) AS sg FROM prow r JOIN theta h ON h.window_id = r.window_id AND h.permno = r.permno WHERE r.ret IS NOT NULL),
skel AS ({_SKEL}),
cells AS ({_cells("leg")}),
scored AS ({_scores("cells", "skel", n_min)}),
stats AS (SELECT s.*, b.win_start, b.win_end, l.regime FROM scored s JOIN bounds b ON b.window_id = s.window_id JOIN lab l ON l.window_id = s.window_id),
ok AS (SELECT * FROM stats WHERE valid)"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in cols)


_STATS = f"SELECT window_id, win_start, win_end, permno_a, permno_b, {_r(*[f'{v}{c}' for v in 'Eab' for c in CELLS])}, {', '.join(f'N{c}' for c in CELLS)}, {_r('s_odd', 'delta', 'ctx')}, valid, regime FROM stats"
_NAIVE, _CBD = "avg(CASE WHEN s_odd > 2 THEN 1.0 ELSE 0.0 END)", "avg(CASE WHEN ctx > 0 THEN 1.0 ELSE 0.0 END)"


def _vix(agg: str, bar: str) -> str:
    return f"lev AS (SELECT b.window_id, {agg} AS level FROM bounds b LEFT JOIN vix v ON v.\"date\" BETWEEN win_start AND win_end GROUP BY 1) SELECT window_id, CASE WHEN level > {bar} THEN 'crisis' ELSE 'calm' END AS regime FROM lev"


def _hist() -> str:
    parts = []
    for var, spec in BINS.items():
        e = edges_of(spec)
        rows = ", ".join(f"(CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), {'true' if k == len(e) - 2 else 'false'})" for k, (a, b) in enumerate(zip(e, e[1:], strict=False)))
        parts.append(f"""SELECT '{var}' AS var, g.regime, bin_left, bin_right, count(o.{var}) AS count FROM (SELECT DISTINCT regime FROM ok) g CROSS JOIN (VALUES {rows}) AS e(bin_left, bin_right, last)
  LEFT JOIN ok o ON o.regime = g.regime AND o.{var} >= bin_left AND (o.{var} < bin_right OR (last AND o.{var} = bin_right)) GROUP BY 1, 2, 3, 4""")
    return "hist AS (" + " UNION ALL ".join(parts) + ")"


def _box(source: str, value: str, by: str) -> str:
    return f"""v AS (SELECT {by}, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
q AS (SELECT {by}, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY {by})
SELECT {by}, n, {_r("q1", "median", "q3")}, round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) + 0.0 AS low, round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) + 0.0 AS high
FROM v JOIN q USING ({by}) GROUP BY {by}, n, q1, median, q3"""


_BOXVAL = 'b AS (SELECT CAST(date_trunc(\'{f}\', "date") AS DATE) AS period, abs(ret) * 100 AS a FROM panel), '
_SECT = "ps AS (SELECT o.*, CASE WHEN x.sector = y.sector THEN {p} || x.sector ELSE 'cross' END AS pair_sector FROM ok o LEFT JOIN sect x ON x.permno = permno_a LEFT JOIN sect y ON y.permno = permno_b)"
_HASH = "md5(concat_ws('|', CAST(window_id AS VARCHAR), CAST(permno_a AS VARCHAR), CAST(permno_b AS VARCHAR), '0'))"
_POOL = f"({' + '.join(f'coalesce(E{c} * N{c}, 0.0)' for c in CELLS)}) / nullif({' + '.join(f'N{c}' for c in CELLS)}, 0)"


def _sweep() -> str:
    ctes = [_panel()]
    for k, q in enumerate(QUANTILES):
        ctes.append(f"""th{k} AS (SELECT window_id, permno, quantile_cont(abs(ret), {q}) AS theta FROM prow WHERE ret IS NOT NULL GROUP BY 1, 2),
leg{k} AS (SELECT r.window_id, r.permno, r.t, CASE WHEN abs(r.ret) >= h.theta THEN 0 ELSE 1 END AS x, sign(r.ret) AS sg FROM prow r JOIN th{k} h ON h.window_id = r.window_id AND h.permno = r.permno WHERE r.ret IS NOT NULL),
skel{k} AS ({_SKEL.replace("theta ", f"th{k} ")}), cells{k} AS ({_cells(f"leg{k}")}), sc{k} AS ({_scores(f"cells{k}", f"skel{k}", 3)})""")
    allq = " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS theta_q, sc{k}.*, least(N00, N01, N10, N11) AS least FROM sc{k}" for k, q in enumerate(QUANTILES))
    f = lambda cond: f"count(*) FILTER (WHERE {cond})"
    rate = lambda c, n: f"round(CAST({f(f'least >= {n} AND {c}')} AS DOUBLE) / nullif({f(f'least >= {n}')}, 0), 9) + 0.0"
    return f"""WITH {", ".join(ctes)}, allq AS ({allq})
SELECT theta_q, regime, 10 AS n_min, 3 AS relaxed_n_min, {f("least >= 10")} AS n_valid, {rate("s_odd > 2", 10)} AS naive_rate, {rate("ctx > 0", 10)} AS cbd_rate,
  {f("least >= 3")} AS n_valid_relaxed, {rate("s_odd > 2", 3)} AS naive_rate_relaxed, {rate("ctx > 0", 3)} AS cbd_rate_relaxed, theta_q IN (0.9, 0.95) AS is_relaxed_diag_q
FROM allq JOIN lab USING (window_id) GROUP BY theta_q, regime"""


_HALVES = f"""
odd AS (SELECT window_id, t, (row_number() OVER (PARTITION BY window_id ORDER BY t) - 1) % 2 AS odd, count(*) OVER (PARTITION BY window_id) AS d FROM (SELECT DISTINCT window_id, t FROM leg)),
good AS (SELECT window_id FROM theta GROUP BY 1 HAVING count(*) >= 3 AND window_id IN (SELECT window_id FROM odd WHERE d >= 8)),
enough AS (SELECT window_id FROM ok WHERE window_id IN (SELECT window_id FROM good) GROUP BY 1 HAVING count(*) >= 3),
lega AS (SELECT leg.* FROM leg JOIN odd USING (window_id, t) WHERE odd = 0), legb AS (SELECT leg.* FROM leg JOIN odd USING (window_id, t) WHERE odd = 1),
ca AS ({_cells("lega")}), cb AS ({_cells("legb")}), sa AS ({_scores("ca", "skel", 2)}), sb AS ({_scores("cb", "skel", 2)}),
half AS (SELECT *, 'a' AS half FROM sa WHERE valid UNION ALL SELECT *, 'b' AS half FROM sb WHERE valid),
hw AS (SELECT h.window_id, h.permno_a, h.permno_b, h.half, h.s_odd AS w_s_odd, h.E00 AS w_e00, {_POOL.replace("E", "h.E").replace("N0", "h.N0").replace("N1", "h.N1")} AS w_pooled,
  count(*) OVER (PARTITION BY h.window_id, h.permno_a, h.permno_b) AS nb FROM half h SEMI JOIN ok USING (window_id, permno_a, permno_b) SEMI JOIN enough USING (window_id)),
hc AS (SELECT *, count(*) OVER (PARTITION BY window_id) AS k FROM hw WHERE nb = 2),
halves AS (SELECT window_id, permno_a, permno_b, half, w_s_odd, w_e00, w_pooled FROM hc WHERE k >= 6)"""


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND var_pop({x}) > 1e-18 AND var_pop({y}) > 1e-18 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


_RELIABILITY = f"""both2 AS (SELECT a.window_id, {", ".join(f"a.w_{v} AS {v}_a, b.w_{v} AS {v}_b" for v in ("s_odd", "e00", "pooled"))} FROM halves a JOIN halves b USING (window_id, permno_a, permno_b) WHERE a.half = 'a' AND b.half = 'b'),
rr AS (SELECT window_id, count(*) AS n_pairs, {", ".join(f"{_corr(f'{v}_a', f'{v}_b')} AS r_{v}" for v in ("s_odd", "e00", "pooled"))} FROM both2 GROUP BY 1)
SELECT window_id, win_start, n_pairs, {", ".join(f"round(r_{v}, 9) + 0.0 AS reliability_halfsplit{s}, round(2 * r_{v} / nullif(1 + r_{v}, 0), 9) + 0.0 AS reliability_sb{s}" for v, s in (("s_odd", ""), ("e00", "_e00"), ("pooled", "_pooled")))} FROM rr JOIN bounds USING (window_id)"""


_BY_VIX = """ref AS (SELECT quantile_cont(vix, 0.5) AS ref FROM vix), exo AS (SELECT "date", CASE WHEN vix >= ref THEN 0 ELSE 1 END AS x FROM vix, ref)"""


def _diag(exo: str = _BY_VIX, n_min: int = N_MIN) -> str:
    """Diagonal cells of the valid pairs under a regime of days, exo ("date", x)."""
    cols = []
    for k, c in ((0, "00"), (1, "11")):
        f = f"FILTER (WHERE a <> 0 AND b <> 0 AND x = {k})"
        cols += [f"count(*) {f} AS N{c}", f"avg(a * b) {f} AS E{c}", f"avg(a) {f} AS a{c}", f"avg(b) {f} AS b{c}"]
    return f"""{exo},
pd AS (SELECT o.window_id, o.permno_a, o.permno_b, o.regime, CAST(sign(l.ret) AS DOUBLE) AS a, CAST(sign(r.ret) AS DOUBLE) AS b, e.x FROM ok o JOIN prow l ON l.window_id = o.window_id AND l.permno = o.permno_a AND l.ret IS NOT NULL
  JOIN prow r ON r.window_id = o.window_id AND r.permno = o.permno_b AND r."date" = l."date" AND r.ret IS NOT NULL LEFT JOIN exo e ON e."date" = l."date"),
g AS (SELECT window_id, permno_a, permno_b, regime, {", ".join(cols)} FROM pd GROUP BY 1, 2, 3, 4)
SELECT window_id, permno_a, permno_b, regime, N00, N11, {_r("E00", "a00", "b00", "E11", "a11", "b11")}, round(E00 - E11, 9) + 0.0 AS dcmov, N00 >= {n_min} AND N11 >= {n_min} AS valid_diag FROM g"""


def _fit(source: str = "ok", n_min: int = N_MIN, q: float = 0.5, k: str = "") -> str:
    """CTEs up to fit{k}: the generators of the source's pairs, not rounded."""
    scales = [f"coalesce(avg({m}) FILTER (WHERE {r} = {k}), avg({m})) AS scale_{leg}{k}" for leg, m, r in (("a", "ma", "x"), ("b", "mb", "y")) for k in (0, 1)]
    cells, out = [], []
    for c in CELLS:
        f = f"FILTER (WHERE x = {c[0]} AND y = {c[1]})"
        cells.append(f"count(*) {f} AS k{c}, avg((a + 1) / 2) {f} AS p{c}, avg((b + 1) / 2) {f} AS q{c}, avg(a * b) {f} AS e{c}")
        ma, mb = f"(2 * p{c} - 1)", f"(2 * q{c} - 1)"
        spread = f"((1 - {ma} * {ma}) * (1 - {mb} * {mb}))"
        rho = f"CASE WHEN k{c} >= 2 AND {spread} > 1e-12 THEN greatest(-1.0, least(1.0, (e{c} - {ma} * {mb}) / sqrt({spread}))) ELSE 0.0 END"
        out += [f"CASE WHEN k{c} >= 2 THEN p{c} ELSE 0.5 END AS pa{c}", f"CASE WHEN k{c} >= 2 THEN q{c} ELSE 0.5 END AS pb{c}", f"{rho} AS rho{c}"]
    return f"""d{k} AS (SELECT o.window_id, o.permno_a, o.permno_b, abs(l.ret) AS ma, abs(r.ret) AS mb, CAST(sign(l.ret) AS DOUBLE) AS a, CAST(sign(r.ret) AS DOUBLE) AS b FROM {source} o
  JOIN prow l ON l.window_id = o.window_id AND l.permno = o.permno_a AND l.ret <> 0 JOIN prow r ON r.window_id = o.window_id AND r.permno = o.permno_b AND r."date" = l."date" AND r.ret <> 0),
t{k} AS (SELECT window_id, permno_a, permno_b, count(*) AS n, quantile_cont(ma, {q}) AS ta, quantile_cont(mb, {q}) AS tb FROM d{k} GROUP BY 1, 2, 3 HAVING count(*) >= {4 * n_min}),
e{k} AS (SELECT d.*, t.n, CAST(ma < ta AS INT) AS x, CAST(mb < tb AS INT) AS y FROM d{k} d JOIN t{k} t USING (window_id, permno_a, permno_b)),
g{k} AS (SELECT window_id, permno_a, permno_b, count(*) AS n_days, {", ".join(scales)}, {", ".join(cells)} FROM e{k} GROUP BY 1, 2, 3),
fit{k} AS (SELECT window_id, permno_a, permno_b, n_days, scale_a0, scale_a1, scale_b0, scale_b1, {", ".join(out)} FROM g{k})"""


_W = f"""w AS (SELECT window_id, 'e00' AS graph, permno_a AS src, permno_b AS dst, E00 AS w FROM ok UNION ALL SELECT window_id, 'pooled', permno_a, permno_b, {_POOL} FROM ok UNION ALL SELECT window_id, 's_odd', permno_a, permno_b, s_odd FROM ok)"""


def _top(share: float, name: str = "top") -> str:
    return f"""{name} AS (SELECT window_id, graph, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY window_id, graph ORDER BY abs(w) DESC, src, dst) AS r, count(*) OVER (PARTITION BY window_id, graph) AS n FROM w) WHERE r <= greatest(1, CAST(round_even({share} * n, 0) AS INT)))"""


_NODES = "nodes AS (SELECT window_id, graph, src AS node FROM w UNION SELECT window_id, graph, dst FROM w)"
_EP = ", ".join("({}, '{}', DATE '{}', DATE '{}', '{}')".format(k, n.replace("'", "''"), a, b, t) for k, (n, a, b, t, _) in enumerate(EPISODES))


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}, {body}" if " AS (" in body.split("SELECT")[0] else f"WITH {ctes} {body}"


def _build() -> dict[str, str]:
    p, s, low = _panel(), _pairs(), _pairs(n_min=N_MIN_LOW)
    out = {
        "panel_returns": _with(p, f'SELECT permno, "date", {_r("ret")} FROM panel'),
        "trading_calendar": _with(p, 'SELECT "date" FROM cal'),
        "membership_spells": _with(p, "SELECT * FROM memb"),
        "members_overlapping": _with(p, "SELECT DISTINCT permno FROM memb WHERE mbrenddt >= DATE '1996-01-01' AND mbrstartdt <= DATE '1996-06-30'"),
        "hopping_windows": _with(p, "SELECT * FROM bounds"),
        "hopping_windows_w120": _with(_panel(120), "SELECT * FROM bounds"),
        "window_eligibility": _with(p, "SELECT window_id, win_start, win_end, permno FROM elig JOIN bounds USING (window_id)"),
        "eligible_per_window": _with(p, "SELECT window_id, count(*) AS n_eligible FROM elig GROUP BY 1"),
        "eligible_summary": _with(p, "c AS (SELECT count(*) AS k FROM elig GROUP BY window_id) SELECT min(k) AS n_min, round(quantile_cont(CAST(k AS DOUBLE), 0.5), 9) + 0.0 AS n_median, max(k) AS n_max, CAST(floor(floor(quantile_cont(CAST(k AS DOUBLE), 0.5)) * (floor(quantile_cont(CAST(k AS DOUBLE), 0.5)) - 1) / 2) AS BIGINT) AS pairs_at_median FROM c"),
        "eligible_over_time": _with(p, "SELECT window_id, win_start, count(*) AS n_eligible, regime FROM elig JOIN bounds USING (window_id) JOIN lab USING (window_id) GROUP BY 1, 2, 4"),
        "identifiers_distinct": _with(p, "SELECT DISTINCT permno, 'B' || CAST(permno AS VARCHAR) AS ticker FROM memb"),
        "first_windows": _with(p, "SELECT window_id, win_start, win_end, permno FROM elig JOIN bounds USING (window_id) WHERE window_id IN (SELECT DISTINCT window_id FROM elig ORDER BY 1 LIMIT 3)"),
        "window_panel": _with(p, f'SELECT window_id, permno, "date", t, {_r("ret")} FROM prow'),
        "leg_thresholds": _with(s, f"SELECT window_id, permno, {_r('theta')} FROM theta"),
        "leg_regimes": _with(s, 'SELECT window_id, permno, "date", x FROM leg'),
        "pair_window_stats": _with(s, _STATS),
        "pair_window_stats_q75": _with(_pairs(n_min=N_MIN_LOW, q=0.75), _STATS),
        "pair_window_stats_w120": _with(_pairs(120), _STATS),
        "pair_skeleton": _with(s, "SELECT * FROM skel"),
        "labels_none": _with(p, "SELECT window_id, 'calm' AS regime FROM bounds"),
        "labels_spans": _with(p, "SELECT * FROM lab"),
        "labels_vix_mean": _with(p, _vix("avg(vix)", "(SELECT quantile_cont(level, 0.5) FROM lev)")),
        "labels_vix_median": _with(p, _vix("quantile_cont(vix, 0.5)", "(SELECT quantile_cont(level, 0.5) FROM lev)")),
        "labels_vix_max": _with(p, _vix("max(vix)", "(SELECT quantile_cont(level, 0.75) FROM lev)")),
        "labels_vix_fixed": _with(p, _vix("avg(vix)", "25.0")),
        "taxonomy_tags": _with(p, f"""ep AS (SELECT * FROM (VALUES {_EP}) AS v(place, name, s, e, type)), h AS (SELECT window_id, place, name, type FROM bounds LEFT JOIN ep ON win_start <= e AND win_end >= s),
n AS (SELECT window_id, coalesce(string_agg(name, ';' ORDER BY place), 'none') AS crisis_names FROM h GROUP BY 1), ty AS (SELECT window_id, coalesce(string_agg(t, ';' ORDER BY t), 'none') AS crisis_types FROM (SELECT DISTINCT window_id, unnest(coalesce(string_split(type, '/'), [NULL])) AS t FROM h) GROUP BY 1)
SELECT window_id, crisis_names, crisis_types FROM n JOIN ty USING (window_id)"""),
        "headline_rates": _with(low, "SELECT regime, count(*) AS n_total, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid AND s_odd > 2) AS n_naive, count(*) FILTER (WHERE valid AND ctx > 0) AS n_cbd, round(CAST(count(*) FILTER (WHERE valid AND s_odd > 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE valid), 0), 9) + 0.0 AS naive_rate, round(CAST(count(*) FILTER (WHERE valid AND ctx > 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE valid), 0), 9) + 0.0 AS cbd_rate FROM stats GROUP BY 1"),
        "violation_rates": _with(low, f"SELECT regime, count(*) AS n_pairs, round({_NAIVE}, 9) + 0.0 AS naive_rate, round({_CBD}, 9) + 0.0 AS cbd_rate FROM ok GROUP BY 1"),
        "stat_hist": _with(low, f"{_hist()} SELECT var, regime, {_r('bin_left', 'bin_right')}, count FROM hist"),
        "stat_density": _with(low, f"{_hist()} SELECT var, regime, round((bin_left + bin_right) / 2, 9) + 0.0 AS center, round(count / nullif(sum(count) OVER (PARTITION BY var, regime) * (bin_right - bin_left), 0), 9) + 0.0 AS density FROM hist"),
        "ctx_overlay": _with(low, f"{_hist()} SELECT {_r('bin_left', 'bin_right')}, CAST(sum(count) AS BIGINT) AS count FROM hist WHERE var = 'ctx' GROUP BY hist.bin_left, hist.bin_right"),
        "score_distributions": _with(low, " UNION ALL ".join(f"SELECT '{v}' AS var, regime, CAST(least(49, coalesce(floor(({v} - lo) / nullif(hi - lo, 0) * 50), 0)) AS INT) AS bin, round(lo, 9) + 0.0 AS lo, round(hi, 9) + 0.0 AS hi, count(*) AS count FROM ok, (SELECT min({v}) AS lo, max({v}) AS hi FROM ok) WHERE {v} IS NOT NULL GROUP BY 2, 3, 4, 5" for v in ("s_odd", "delta", "ctx"))),
        "coupling_amount": _with(low, "e AS (SELECT window_id, count(DISTINCT p) AS n FROM (SELECT window_id, permno_a AS p FROM ok UNION ALL SELECT window_id, permno_b FROM ok) GROUP BY 1), m AS (SELECT window_id, regime, count(*) FILTER (WHERE s_odd >= 2) AS m FROM ok GROUP BY 1, 2) SELECT regime, round(avg(coalesce(2.0 * m / nullif(n * (n - 1), 0), 0.0)), 9) + 0.0 AS edge_density, count(*) AS n_windows FROM m JOIN e USING (window_id) GROUP BY 1"),
        "cell_summary": _with(low, f"SELECT regime, count(*) AS n_valid, {', '.join(f'round(avg(N{c}), 9) + 0.0 AS N{c}' for c in CELLS)} FROM ok GROUP BY 1"),
        "cell_count_boxes": _with(low, "cc AS (" + " UNION ALL ".join(f"SELECT regime, '{c}' AS cell, CAST(N{c} AS DOUBLE) AS k FROM ok" for c in CELLS) + "), " + _box("cc", "k", "regime, cell")),
        "sector_rates": _with(low, f"{_SECT.format(p=chr(39) + 'within:' + chr(39))} SELECT regime, pair_sector, count(*) AS n_pairs, round({_NAIVE}, 9) + 0.0 AS naive_rate, round({_CBD}, 9) + 0.0 AS cbd_rate FROM ps GROUP BY 1, 2"),
        "sector_rates_sorted": _with(low, f"{_SECT.format(p=chr(39) * 2)} SELECT pair_sector, count(*) AS n_pairs, round({_NAIVE}, 9) + 0.0 AS naive_rate, round({_CBD}, 9) + 0.0 AS cbd_rate FROM ps GROUP BY 1"),
        "coverage_by_year": _with(p, "SELECT CAST(year(\"date\") AS INT) AS year, count(*) AS n_rows, round(avg(CASE WHEN ret IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS availability, round(avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END), 9) + 0.0 AS zero_rate FROM panel GROUP BY 1"),
        "theta_band": _with(s, "SELECT window_id, round(quantile_cont(theta, 0.1), 9) + 0.0 AS q10, round(quantile_cont(theta, 0.5), 9) + 0.0 AS median, round(quantile_cont(theta, 0.9), 9) + 0.0 AS q90 FROM theta GROUP BY 1"),
        "absret_month_box": _with(p, _BOXVAL.format(f="month") + _box("b", "a", "period")),
        "absret_quarter_box": _with(p, _BOXVAL.format(f="quarter") + _box("b", "a", "period")),
        "return_hist": _with(p, f"""k AS (SELECT abs(ret) AS v FROM panel WHERE abs(ret) < (SELECT quantile_cont(abs(ret), 0.999) FROM panel)), sp AS (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5) AS theta FROM k)
SELECT CAST(least(79, coalesce(floor((v - lo) / nullif((hi - lo) / 80, 0)), 0)) AS INT) AS bin, {_r("theta")}, count(*) AS count FROM k, sp GROUP BY 1, theta"""),
        "index_equal_weight": _with(p, """d AS (SELECT "date", avg(ret) AS r FROM panel GROUP BY 1), g AS (SELECT "date", exp(sum(ln(1 + coalesce(r, 0.0))) OVER (ORDER BY "date")) AS g FROM d), lv AS (SELECT "date", sum(CAST(round(rev * 100) AS BIGINT)) / 100.0 AS l FROM brandrev GROUP BY 1)
SELECT "date", round(ln(g / first_value(g) OVER (ORDER BY "date")), 6) + 0.0 AS equal_weight, round(ln(CAST(l AS DOUBLE) / first_value(CAST(l AS DOUBLE)) OVER (ORDER BY "date")), 6) + 0.0 AS index_level FROM g JOIN lv USING ("date")"""),
        "regime_table": _with(s, "SELECT window_id, min(win_start) AS win_start, min(regime) AS regime FROM stats GROUP BY 1"),
        "crisis_runs": _with(s, """r AS (SELECT window_id, min(win_start) AS ws, min(regime) AS regime FROM stats GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY window_id) AS k FROM r), c AS (SELECT *, k - row_number() OVER (ORDER BY window_id) AS run FROM i WHERE regime = 'crisis')
SELECT min(window_id) AS first_window, max(window_id) AS last_window, min(ws) AS start, max(ws) AS "end", count(*) AS n FROM c GROUP BY run"""),
        "scatter_quota": _with(low, f"q AS (SELECT greatest(1, CAST(floor(20000.0 / count(DISTINCT window_id)) AS BIGINT)) AS quota FROM ok), r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY {_HASH}, permno_a, permno_b) AS k FROM ok) SELECT window_id, permno_a, permno_b, {_r('s_odd', 'delta', 'ctx')}, regime FROM r, q WHERE k <= quota"),
        "sample_pairs": _with(low, f"SELECT window_id, permno_a, permno_b, {_r('s_odd')} FROM (SELECT * FROM ok ORDER BY {_HASH}, window_id, permno_a, permno_b LIMIT 200)"),
        "group_sample": _with(low, f"SELECT regime, window_id, permno_a, permno_b, {_r('ctx')} FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY md5(concat_ws('|', regime, CAST(window_id AS VARCHAR), CAST(permno_a AS VARCHAR), CAST(permno_b AS VARCHAR), '0')), window_id, permno_a, permno_b) AS k FROM ok) WHERE k <= 40"),
        "pooled_weights": _with(s, f"SELECT window_id, permno_a, permno_b, round({_POOL}, 9) + 0.0 AS w_pooled FROM ok"),
        "threshold_sweep": _sweep(),
        "split_half_weights": _with(s, f"{_HALVES.strip()} SELECT window_id, permno_a, permno_b, half, {_r('w_s_odd', 'w_e00', 'w_pooled')} FROM halves"),
        "split_half_reliability": _with(s, f"{_HALVES.strip()}, {_RELIABILITY}"),
        "vix_regime_full": _with(p, 'ref AS (SELECT quantile_cont(vix, 0.5) AS ref FROM vix) SELECT "date", CASE WHEN vix >= ref THEN 0 ELSE 1 END AS x FROM vix, ref'),
        "vix_regime_rolling": _with(p, 'SELECT "date", CASE WHEN vix >= quantile_cont(vix, 0.5) OVER (ORDER BY "date" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 0 ELSE 1 END AS x FROM vix'),
        "exogenous_contrast": _with(s, _diag()),
        "generator_fit": _with(s, f"""{_fit()} SELECT window_id, permno_a, permno_b, n_days, {_r(*[f"scale_{g}{k}" for g in "ab" for k in (0, 1)], *[f"{v}{c}" for v in ("pa", "pb", "rho") for c in CELLS])} FROM fit"""),
        "edge_weights": _with(s, f"{_W} SELECT window_id, graph, src, dst, {_r('w')} FROM w"),
        "top_edges": _with(s, f"{_W}, {_top(0.05)} SELECT window_id, graph, src, dst, {_r('w')} FROM top"),
        "abs_edges": _with(low, f"{_W} SELECT window_id, 's_odd_abs' AS graph, src, dst, {_r('w')} FROM w WHERE graph = 's_odd' AND w >= 2"),
        "graph_density": _with(s, f"{_W}, {_top(0.05)}, {_NODES}, n AS (SELECT window_id, graph, count(*) AS n_nodes FROM nodes GROUP BY 1, 2), m AS (SELECT window_id, graph, count(*) AS n_edges FROM top GROUP BY 1, 2) SELECT window_id, graph, n_nodes, coalesce(n_edges, 0) AS n_edges, round(coalesce(2.0 * n_edges / nullif(n_nodes * (n_nodes - 1), 0), 0.0), 9) + 0.0 AS edge_density FROM n LEFT JOIN m USING (window_id, graph)"),
        "graph_clustering": _with(s, f"""{_W}, {_top(0.2)}, {_NODES}, tri AS (SELECT x.window_id, x.graph, x.src AS a, x.dst AS b, y.dst AS c FROM top x JOIN top y ON x.window_id = y.window_id AND x.graph = y.graph AND x.dst = y.src JOIN top z ON z.window_id = x.window_id AND z.graph = x.graph AND z.src = x.src AND z.dst = y.dst),
t AS (SELECT window_id, graph, node, count(*) AS t FROM (SELECT window_id, graph, a AS node FROM tri UNION ALL SELECT window_id, graph, b FROM tri UNION ALL SELECT window_id, graph, c FROM tri) GROUP BY 1, 2, 3), d AS (SELECT window_id, graph, node, count(*) AS d FROM (SELECT window_id, graph, src AS node FROM top UNION ALL SELECT window_id, graph, dst FROM top) GROUP BY 1, 2, 3)
SELECT window_id, graph, round(avg(coalesce(2.0 * t / nullif(d * (d - 1), 0), 0.0)), 9) + 0.0 AS avg_clustering FROM nodes LEFT JOIN d USING (window_id, graph, node) LEFT JOIN t USING (window_id, graph, node) GROUP BY 1, 2"""),
        "partition_modularity": _with(s, f"""{_W}, {_top(0.05)}, e AS (SELECT window_id, graph, src // 10 AS cs, dst // 10 AS cd, w FROM top WHERE graph = 's_odd'), m AS (SELECT window_id, graph, sum(w) AS m FROM e GROUP BY 1, 2), i AS (SELECT window_id, graph, cs AS c, sum(w) AS l FROM e WHERE cs = cd GROUP BY 1, 2, 3),
k AS (SELECT window_id, graph, c, sum(w) AS k FROM (SELECT window_id, graph, cs AS c, w FROM e UNION ALL SELECT window_id, graph, cd, w FROM e) GROUP BY 1, 2, 3)
SELECT window_id, graph, round(sum(coalesce(l, 0.0) / m - pow(k / (2 * m), 2)), 9) + 0.0 AS modularity FROM k JOIN m USING (window_id, graph) LEFT JOIN i USING (window_id, graph, c) GROUP BY 1, 2"""),
        "edge_jaccard": _with(s, f"""{_HALVES.strip()}, hn AS (SELECT window_id FROM halves GROUP BY 1 HAVING count(*) >= 20), wh AS (SELECT window_id, half, 'e00' AS graph, permno_a AS src, permno_b AS dst, w_e00 AS w FROM halves SEMI JOIN hn USING (window_id) UNION ALL SELECT window_id, half, 'pooled', permno_a, permno_b, w_pooled FROM halves SEMI JOIN hn USING (window_id) UNION ALL SELECT window_id, half, 's_odd', permno_a, permno_b, w_s_odd FROM halves SEMI JOIN hn USING (window_id)),
th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, half, graph ORDER BY abs(w) DESC, src, dst) AS r, count(*) OVER (PARTITION BY window_id, half, graph) AS n FROM wh) WHERE r <= greatest(1, CAST(round_even(0.05 * n, 0) AS INT))),
j AS (SELECT window_id, graph, src, dst, count(*) AS k FROM th GROUP BY 1, 2, 3, 4)
SELECT window_id, graph, round(CAST(count(*) FILTER (WHERE k = 2) AS DOUBLE) / count(*), 9) + 0.0 AS jaccard_topq FROM j GROUP BY 1, 2"""),
        "graph_giant": "WITH RECURSIVE " + s.strip() + f""", {_W}, {_top(0.05)}, {_NODES}, link AS (SELECT window_id, graph, src AS u, dst AS v FROM top UNION SELECT window_id, graph, dst, src FROM top),
reach AS (SELECT window_id, graph, node AS u, node AS v FROM nodes UNION SELECT r.window_id, r.graph, r.u, l.v FROM reach r JOIN link l ON l.window_id = r.window_id AND l.graph = r.graph AND l.u = r.v),
size AS (SELECT window_id, graph, u, count(*) AS k FROM reach GROUP BY 1, 2, 3)
SELECT window_id, graph, CAST(count(*) AS INT) AS n_nodes, round(CAST(max(k) AS DOUBLE) / count(*), 9) + 0.0 AS giant_frac FROM size GROUP BY 1, 2""",
        "qap_observed": _with(s, f"""z AS (SELECT window_id, {_POOL} AS p, E00 AS e, s_odd AS s FROM ok), c AS (SELECT window_id, count(*) AS n, {_corr("p", "e")} AS r_pooled_e00, {_corr("p", "s")} AS r_pooled_s_odd, {_corr("e", "s")} AS r_e00_s_odd FROM z GROUP BY 1)
SELECT window_id, n, {_r("r_pooled_e00", "r_pooled_s_odd", "r_e00_s_odd")}, round(CASE WHEN 1 - r_pooled_e00 * r_pooled_e00 > 1e-12 THEN (r_pooled_s_odd * r_pooled_s_odd + r_e00_s_odd * r_e00_s_odd - 2 * r_pooled_s_odd * r_e00_s_odd * r_pooled_e00) / (1 - r_pooled_e00 * r_pooled_e00) END, 9) + 0.0 AS gate_r2 FROM c"""),
        "table_list": " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_cols" for t in TABLES),
        "table_spans": " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS \"column\", min({c}) AS first_time, max({c}) AS last_time FROM {t}" for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))),
        "table_head": _with(p, f'SELECT permno, "date", {_r("ret")} FROM (SELECT * FROM panel ORDER BY permno, "date" LIMIT 20)'),
        "human_sizes": "SELECT n_nationkey, CASE " + " ".join(f"WHEN b < pow(1024, {k + 1}) THEN printf('%.1f {u}', b / pow(1024, {k}))" for k, u in enumerate(("B", "KB", "MB", "GB"))) + " ELSE printf('%.1f TB', b / pow(1024, 4)) END AS size FROM (SELECT n_nationkey, pow(5.0, n_nationkey) AS b FROM nation)",
        "round_trip_parquet": _with(p, "SELECT window_id, win_start, win_end, permno FROM elig JOIN bounds USING (window_id)"),
        "round_trip_csv": _with(p, "SELECT window_id, win_start, win_end, permno FROM elig JOIN bounds USING (window_id)"),
        "returns_renamed": _with(p, f'SELECT permno, "date", {_r("ret")}, CAST(permno AS DOUBLE) AS prc, CAST(NULL AS DOUBLE) AS vol FROM panel'),
        "table_summary": _with(p, 'SELECT count(*) AS n_rows, min("date") AS first_date, max("date") AS last_date, 3 AS n_cols FROM panel'),
    }
    return out


ORACLE_SQL: dict[str, str] = _build()

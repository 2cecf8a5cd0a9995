"""DuckDB SQL for regimes known beforehand, weighted pairs, share classes and double semi-partialling, day by day and cell by cell."""

from __future__ import annotations

from .oracles import _POOL, CELLS, _cells, _corr, _diag, _pairs, _panel, _r, _scores
from .queries import N_MIN_LOW
from .simulated import _base, _draws

_VALUES = f"{_r(*[f'{v}{c}' for v in 'Eab' for c in CELLS])}, {', '.join(f'N{c}' for c in CELLS)}, {_r('s_odd', 'delta', 'ctx')}, valid"
_VOL = """vol AS (SELECT permno, "date", CASE WHEN count(ret) OVER f >= 10 THEN sqrt(avg(ret * ret) OVER f) END AS vol FROM panel WHERE ret IS NOT NULL
  WINDOW f AS (PARTITION BY permno ORDER BY "date" ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def _lagged() -> str:
    known = f"""{_VOL}, known AS (SELECT r.*, vol, quantile_cont(vol, 0.5) OVER (PARTITION BY window_id, permno) AS theta FROM prow r JOIN vol v USING (permno, "date") WHERE r.ret IS NOT NULL AND vol IS NOT NULL),
lag_leg AS (SELECT window_id, permno, t, CASE WHEN vol >= theta THEN 0 ELSE 1 END AS x, sign(ret) AS sg FROM known),
lag_skel AS (SELECT l.window_id, l.permno AS permno_a, r.permno AS permno_b FROM (SELECT DISTINCT window_id, permno FROM lag_leg) l JOIN (SELECT DISTINCT window_id, permno FROM lag_leg) r ON l.window_id = r.window_id AND l.permno < r.permno),
lag_cells AS ({_cells("lag_leg")})"""
    return f"WITH {_panel()}, {known}, lag AS ({_scores('lag_cells', 'lag_skel', N_MIN_LOW)}) SELECT window_id, permno_a, permno_b, {_VALUES} FROM lag"


_ROLLED = """mon AS (SELECT min(CAST(o_orderdate AS DATE)) AS opening, max(CAST(o_orderdate AS DATE)) AS closing FROM orders GROUP BY date_trunc('month', o_orderdate)),
ann AS (SELECT opening AS day FROM mon UNION ALL SELECT closing FROM mon),
rolled AS (SELECT (SELECT min("date") FROM cal WHERE "date" >= day) AS "date" FROM ann)"""


def _announced(days: int) -> str:
    """The contrast of days that are at most so many calendar days from an announcement."""
    exo = f'{_ROLLED}, exo AS (SELECT c."date", CASE WHEN EXISTS (SELECT 1 FROM rolled JOIN cal h USING ("date") WHERE abs(h.i - c.i) <= {days}) THEN 0 ELSE 1 END AS x FROM cal c)'
    return f"WITH {_pairs()}, {_diag(exo, N_MIN_LOW)}"


_UNITS = """units AS (SELECT CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS INT) AS permno, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS "date", CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS vol FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""


def _weighted() -> str:
    cols = []
    for c in CELLS:
        f = f"FILTER (WHERE x = {c[0]} AND y = {c[1]})"
        cols += [f"count(*) {f} AS N{c}", f"CAST(coalesce(sum(w) {f}, 0) AS BIGINT) AS W{c}"]
        cols += [f"CAST(sum(w * {v}) {f} AS DOUBLE) / nullif(sum(w) {f}, 0) AS {n}{c}" for n, v in (("E", "a * b"), ("a", "a"), ("b", "b"))]
    scored = _scores("wcells", "skel", N_MIN_LOW).replace("coalesce(N00, 0) AS N00", ", ".join(f"coalesce(W{c}, 0) AS W{c}" for c in CELLS) + ", coalesce(N00, 0) AS N00", 1)
    scored = scored.replace(f">= {N_MIN_LOW} AS valid", f">= {N_MIN_LOW} AND least({', '.join(f'coalesce(W{c}, 0)' for c in CELLS)}) > 0 AS valid")
    return f"""WITH {_pairs(n_min=N_MIN_LOW)}, {_UNITS}, bar AS (SELECT avg(vol) / 2 AS bar FROM units),
tw AS (SELECT permno, "date", vol < bar AS thin, CAST(floor(3 * sum(CASE WHEN vol < bar THEN 0 ELSE 1 END) OVER f / CAST(count(*) OVER f AS DOUBLE)) AS INT) AS weight FROM units, bar WINDOW f AS (PARTITION BY permno ORDER BY "date" ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
wleg AS (SELECT leg.*, coalesce(weight, 0) AS w, coalesce(thin, true) AS thin FROM leg LEFT JOIN tw USING (permno, "date")),
flag AS (SELECT window_id, permno, avg(CASE WHEN thin THEN 1.0 ELSE 0.0 END) > 0.25 AS thin FROM wleg GROUP BY 1, 2),
wday AS (SELECT l.window_id, l.permno AS permno_a, r.permno AS permno_b, l.x, r.x AS y, l.sg AS a, r.sg AS b, l.w * r.w AS w FROM wleg l JOIN wleg r ON l.window_id = r.window_id AND l.t = r.t AND l.permno < r.permno WHERE l.sg <> 0 AND r.sg <> 0),
wcells AS (SELECT window_id, permno_a, permno_b, {", ".join(cols)} FROM wday GROUP BY 1, 2, 3),
wscored AS ({scored})
SELECT window_id, permno_a, permno_b, {", ".join(f"W{c}" for c in CELLS)}, {_VALUES}, fa.thin AS thin_a, fb.thin AS thin_b FROM wscored s JOIN (SELECT window_id, permno AS permno_a, thin FROM flag) fa USING (window_id, permno_a) JOIN (SELECT window_id, permno AS permno_b, thin FROM flag) fb USING (window_id, permno_b)"""


def _classes() -> str:
    return f"""WITH {_panel()}, {_UNITS},
sp AS (SELECT permno, permno // 3 AS permco, lo AS s, CASE WHEN permno % 4 = 0 THEN CAST(lo + 900 AS DATE) END AS e FROM (SELECT DISTINCT permno FROM panel), span WHERE permno % 10 <> 0
  UNION ALL SELECT permno, permno // 3 + 1, CAST(lo + 800 AS DATE), hi FROM (SELECT DISTINCT permno FROM panel), span WHERE permno % 10 <> 0 AND permno % 4 = 0),
el AS (SELECT window_id, permno, win_start, win_end FROM elig JOIN bounds USING (window_id)),
firm AS (SELECT el.*, (SELECT first(permco ORDER BY s DESC, permco) FROM sp WHERE sp.permno = el.permno AND win_end >= s AND (e IS NULL OR win_end <= e)) AS firm FROM el),
traded AS (SELECT window_id, permno, sum(vol) AS traded FROM units JOIN wcal USING ("date") GROUP BY 1, 2),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY window_id, firm ORDER BY coalesce(traded, 0) DESC, permno) AS place FROM firm f LEFT JOIN traded USING (window_id, permno))
SELECT window_id, win_start, win_end, permno FROM ranked WHERE firm IS NULL OR place = 1"""


def _partialled(n_perm: int = 199) -> str:
    """For each window and predictor: residuals on the other one, relabelled, and t from correlations given the other one."""
    given = "({ye} - {yx} * {ex}) / nullif(sqrt((1 - {yx} * {yx}) * (1 - {ex} * {ex})), 0)".format(ye="r_ye", yx="r_yx", ex="r_ex")
    t = "CASE WHEN n > 3 AND abs(r) < 1 - 1e-12 THEN r * sqrt((n - 3) / (1 - r * r)) END"
    moments = f"count(*) AS n, {_corr('y', 'e')} AS r_ye, {_corr('y', 'x')} AS r_yx, {_corr('e', 'x')} AS r_ex"
    return f"""WITH {_pairs()},
m AS (SELECT window_id, regime, permno_a, permno_b, {_POOL} AS pooled, E00 AS e00, s_odd FROM ok),
node AS (SELECT window_id, p, row_number() OVER (PARTITION BY window_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY window_id) AS n FROM (SELECT window_id, permno_a AS p FROM m UNION SELECT window_id, permno_b FROM m)),
big AS (SELECT window_id, CAST(max(n) AS INT) AS n_nodes FROM node GROUP BY 1 HAVING max(n) >= 5),
two AS (SELECT window_id, regime, 'pooled' AS predictor, permno_a, permno_b, s_odd AS y, pooled AS z, e00 AS x FROM m SEMI JOIN big USING (window_id) UNION ALL SELECT window_id, regime, 'e00', permno_a, permno_b, s_odd, e00, pooled FROM m SEMI JOIN big USING (window_id)),
line AS (SELECT window_id, predictor, covar_pop(z, x) / nullif(var_pop(x), 0) AS slope, avg(z) AS mz, avg(x) AS mx FROM two GROUP BY 1, 2),
res AS (SELECT two.*, z - mz - coalesce(slope, 0) * (x - mx) AS e FROM two JOIN line USING (window_id, predictor)),
seen AS (SELECT *, {t} AS t FROM (SELECT *, {given} AS r FROM (SELECT window_id, predictor, min(regime) AS regime, sum(y * e) / nullif(sum(e * e), 0) AS coef, {moments} FROM res GROUP BY 1, 2))),
turn AS (SELECT window_id, predictor, perm, p, row_number() OVER (PARTITION BY window_id, predictor, perm ORDER BY u, i) - 1 AS place
  FROM {_draws(f"(SELECT node.*, predictor, {_base("'dsp'", "window_id", "predictor", "0")} AS base, unnest(generate_series(0, {n_perm - 1})) AS perm FROM node SEMI JOIN big USING (window_id), (SELECT unnest(['pooled', 'e00']) AS predictor))", "base", "perm * n + i")}),
swap AS (SELECT t.window_id, t.predictor, t.perm, s.p AS old, t.p AS new FROM turn t JOIN node s ON s.window_id = t.window_id AND s.i = t.place),
crossed AS (SELECT o.window_id, o.predictor, a.perm, o.y, o.x, v.e FROM res o JOIN swap a ON a.window_id = o.window_id AND a.predictor = o.predictor AND a.old = o.permno_a JOIN swap b ON b.window_id = o.window_id AND b.predictor = o.predictor AND b.perm = a.perm AND b.old = o.permno_b
  JOIN res v ON v.window_id = o.window_id AND v.predictor = o.predictor AND v.permno_a = least(a.new, b.new) AND v.permno_b = greatest(a.new, b.new)),
moved AS (SELECT window_id, predictor, perm, {t} AS t FROM (SELECT *, {given} AS r FROM (SELECT window_id, predictor, perm, {moments} FROM crossed GROUP BY 1, 2, 3))),
pv AS (SELECT window_id, predictor, (1.0 + count(*) FILTER (WHERE abs(m.t) >= abs(s.t) - 1e-9 * greatest(1.0, abs(s.t)))) / (1 + count(m.t)) AS p FROM seen s LEFT JOIN moved m USING (window_id, predictor) GROUP BY 1, 2)
SELECT window_id, regime, predictor, n_nodes, round(CASE WHEN t IS NOT NULL THEN coef END, 9) + 0.0 AS coef, round(t, 9) + 0.0 AS t, round(CASE WHEN t IS NOT NULL THEN p END, 9) + 0.0 AS p FROM seen JOIN big USING (window_id) JOIN pv USING (window_id, predictor)"""


ORACLE_SQL: dict[str, str] = {
    "lagged_volatility": f'WITH {_panel()}, {_VOL} SELECT permno, "date", {_r("vol")} FROM vol',
    "lagged_pair_stats": _lagged(),
    "announcement_days": f'WITH {_panel()}, {_ROLLED} SELECT "date", count(*) AS n_events FROM rolled WHERE "date" IS NOT NULL GROUP BY 1',
    "announcement_contrast": _announced(0),
    "announcement_contrast_around": _announced(1),
    "streamed_pair_stats": f'WITH {_pairs(n_min=N_MIN_LOW)} SELECT s.window_id, permno_a, permno_b, {_VALUES} FROM scored s JOIN bounds b ON b.window_id = s.window_id WHERE win_end + 1 <= (SELECT max("date") FROM panel WHERE ret IS NOT NULL) - 14',
    "weighted_pair_stats": _weighted(),
    "one_class_per_firm": _classes(),
    "qap_partialled": _partialled(),
}

"""The jobs as queries: each runs twice into one new folder, and the output is what is there after the second run; and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.plans import oracles
from quadrille.plans.queries import rounded

from . import common, market_update, source_volumes


def _twice(job: str, run: Callable, read: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = common.new_folder(spark, job)
        for _ in range(2):
            run(spark, sf_dir, out, common.settings(job))
        return rounded(read(spark, out))

    return query


QUERIES = {
    "job1_market_update": _twice("market_update", market_update.run, market_update.read_pairs),
    "job2_source_volumes": _twice("source_volumes", source_volumes.run, source_volumes.read_pairs),
}


def _scored(c: dict, ctes: str) -> str:
    """From present (window_id, permno, t, ret), the rows of members that are there throughout."""
    return f"""{ctes},
prow AS (SELECT * FROM present QUALIFY count(*) OVER (PARTITION BY window_id, permno) >= {c["least_presence"] * c["width"]}),
theta AS (SELECT window_id, permno, quantile_cont(abs(ret), {c["theta_quantile"]}) AS theta FROM prow WHERE ret IS NOT NULL GROUP BY 1, 2),
leg AS (SELECT r.window_id, r.permno, r.t, CASE WHEN abs(r.ret) >= h.theta THEN 0 ELSE 1 END AS x, sign(r.ret) AS sg FROM prow r JOIN theta h USING (window_id, permno) WHERE r.ret IS NOT NULL),
skel AS ({oracles._SKEL}), cells AS ({oracles._cells("leg")}), scored AS ({oracles._scores("cells", "skel", c["n_min"])})"""


_VALUES = f"{oracles._r(*[f'{v}{c}' for v in 'Eab' for c in oracles.CELLS])}, {', '.join(f'N{c}' for c in oracles.CELLS)}, {oracles._r('s_odd', 'delta', 'ctx')}, valid"


def _market() -> str:
    c = common.settings("market_update")
    w, s = c["width"], c["step"]
    spans = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in oracles.RECESSIONS)
    panel = f"""weekly AS (SELECT CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS INT) AS permno, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS day,
  CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS rev FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
panel AS (SELECT a.permno, a.day, a.rev / b.rev - 1 AS ret FROM weekly a LEFT JOIN weekly b ON b.permno = a.permno AND b.day = a.day - 7 WHERE a.day < (SELECT max(day) FROM weekly)),
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM panel)),
wins AS (SELECT CAST(unnest(generate_series(0, (SELECT CAST(floor((max(n) - {w}) / {s}.0) AS BIGINT) FROM cal))) AS INT) AS window_id),
wcal AS (SELECT window_id, day, i - window_id * {s} AS t FROM cal JOIN wins ON i >= window_id * {s} AND i < window_id * {s} + {w}),
bounds AS (SELECT window_id, min(day) AS win_start, max(day) AS win_end FROM wcal GROUP BY 1),
recess AS (SELECT * FROM (VALUES {spans}) AS v(s, e)),
present AS (SELECT window_id, permno, t, ret FROM panel JOIN wcal USING (day))"""
    label = "CASE WHEN EXISTS (SELECT 1 FROM recess WHERE win_start <= e AND win_end >= s) THEN 'crisis' ELSE 'calm' END"
    return f"WITH {_scored(c, panel)} SELECT window_id, win_start, win_end, permno_a, permno_b, {_VALUES}, {label} AS regime FROM scored JOIN bounds USING (window_id)"


def _volumes() -> str:
    c = common.settings("source_volumes")
    w, s = c["width"], c["step"]
    panel = f"""v AS (SELECT CAST(floor(doc_id / {c["block"]}.0) AS BIGINT) AS i, coalesce(source, 'unknown') AS permno, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2),
panel AS (SELECT a.i, a.permno, a.n / nullif(b.n, 0) - 1 AS ret FROM v a LEFT JOIN v b ON b.permno = a.permno AND b.i = a.i - 1 WHERE a.i < (SELECT max(i) FROM v)),
wins AS (SELECT CAST(unnest(generate_series(0, CAST(floor(((SELECT max(i) FROM v) - {w}) / {s}.0) AS BIGINT))) AS INT) AS window_id),
present AS (SELECT window_id, permno, i - window_id * {s} AS t, ret FROM panel JOIN wins ON i >= window_id * {s} AND i < window_id * {s} + {w})"""
    return f"WITH {_scored(c, panel)} SELECT window_id, CAST(window_id * {s} AS BIGINT) AS first_block, CAST(window_id * {s} + {w} - 1 AS BIGINT) AS last_block, permno_a AS source_a, permno_b AS source_b, {_VALUES} FROM scored"


ORACLE_SQL = {"job1_market_update": _market(), "job2_source_volumes": _volumes()}

import itertools
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import scores
from quadrille.operators import aggregates, blocks, draws, exogenous, graphs, labels, nulls, pairs, sweep, windows

START = date(2020, 1, 1)


def make_panel(spark, members, days, seed, gaps=False):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(1, members + 1):
        for d in range(days):
            r = float(rng.normal(0, 0.02))
            if gaps:
                u = rng.random()
                r = None if u < 0.08 else 0.0 if u < 0.14 else r
            rows.append((p, START + timedelta(d), r))
    return spark.createDataFrame(rows, "permno int, date date, ret double")


def set_up(spark, panel, width, step=21):
    cal = windows.trading_calendar(panel)
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    memb = panel.select("permno").distinct().select("permno", F.lit(span["a"]).alias("mbrstartdt"), F.lit(span["b"]).alias("mbrenddt"))
    elig = windows.window_eligibility(memb, cal, width, step)
    return windows.window_panel(panel, elig, cal, width, step).persist(), windows.hopping_windows(cal, width, step).persist()


def loop_stats(rows, q, n_min):
    """The pair table by plain loops."""
    out, by = {}, {}
    for r in rows:
        if r["ret"] is not None:
            by.setdefault(r["window_id"], {}).setdefault(r["permno"], {})[r["t"]] = r["ret"]
    for w, legs in by.items():
        theta = {p: np.quantile(np.abs(list(v.values())), q) for p, v in legs.items()}
        for a, b in itertools.combinations(sorted(legs), 2):
            cells = {c: [] for c in scores.CELLS}
            for t in legs[a].keys() & legs[b].keys():
                x, y = legs[a][t], legs[b][t]
                if x and y:
                    cells[f"{int(abs(x) < theta[a])}{int(abs(y) < theta[b])}"].append((np.sign(x), np.sign(y)))
            n, s = [len(cells[c]) for c in scores.CELLS], None
            if min(n) >= max(1, n_min):
                e, ma, mb = ([np.mean([f(*z) for z in cells[c]]) for c in scores.CELLS] for f in (lambda i, j: i * j, lambda i, j: i, lambda i, j: j))
                top = max(abs(sum(e) - 2 * v) for v in e)
                d = abs(ma[0] - ma[1]) + abs(ma[2] - ma[3]) + abs(mb[0] - mb[2]) + abs(mb[1] - mb[3])
                s = (top, d, top - d - 2)
            out[w, a, b] = (n, s)
    return out


@pytest.mark.parametrize("q", [0.5, 0.75])
def test_pairs_agree_with_loops(spark, q, monkeypatch):
    rows, bounds = set_up(spark, make_panel(spark, 5, 91, 3, gaps=True), 70)
    want = loop_stats(rows.collect(), q, 5)
    for tile in (256, 2, 1):
        monkeypatch.setattr(pairs, "TILE", tile)
        got = {(r["window_id"], r["permno_a"], r["permno_b"]): r for r in pairs.pair_window_stats(rows, bounds, 70, 5, q).collect()}
        assert got.keys() == want.keys()
        for k, (n, s) in want.items():
            r = got[k]
            assert [r[f"N{c}"] for c in scores.CELLS] == n and r["valid"] == (s is not None)
            if s:
                assert np.allclose([r["s_odd"], r["delta"], r["ctx"]], s, atol=1e-12)
            else:
                assert r["s_odd"] is r["delta"] is r["ctx"] is None


def score_row(spark, e, a, b):
    lit = lambda v: [F.lit(float(x)) for x in v]
    s, d = scores.s_odd(lit(e)), scores.delta(lit(a), lit(b))
    return spark.range(1).select(s.alias("s"), d.alias("d"), scores.ctx(s, d).alias("c")).first()


def test_known_scores(spark):
    r = score_row(spark, (0.6, 0.5, 0.5, -0.7), (-0.20, -0.05, 0.05, 0.10), (-0.15, 0, 0.05, 0.10))
    assert np.allclose([r["s"], r["d"], r["c"]], [2.3, 0.5, -0.2])
    for c in (0.25, 0.5, 0.9, 1):
        r = score_row(spark, (c, c, c, -c), (0,) * 4, (0,) * 4)
        assert np.allclose([r["s"], r["c"]], [4 * c, 4 * c - 2])
    assert score_row(spark, (1,) * 4, (0,) * 4, (0,) * 4)["c"] == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(20, 80))
def test_score_invariants(seed, n):
    rng = np.random.default_rng(seed)
    a, b = rng.choice([-1.0, 0.0, 1.0], n), rng.choice([-1.0, 1.0], n)
    x, y = rng.integers(0, 2, n), rng.integers(0, 2, n)
    k, e, ma, mb, s, d, c = scores.pair_arrays(a, b, x, y)
    k2, e2, mb2, ma2, s2, d2, _ = scores.pair_arrays(b, a, y, x)
    assert k.sum() == (a != 0).sum() and (k[[0, 2, 1, 3]] == k2).all()
    if k.min() > 0:
        assert 0 <= s <= 4 and d >= 0 and np.isclose(c, s - d - 2) and np.isclose(s, s2) and np.isclose(d, d2)


def test_windows_and_eligibility(spark):
    cal = windows.trading_calendar(make_panel(spark, 2, 130, 0))
    got = sorted(map(tuple, windows.hopping_windows(cal, 60, 21).collect()))
    assert got == [(k, START + timedelta(21 * k), START + timedelta(21 * k + 59)) for k in range(4)]
    spells = [(1, START, START + timedelta(70)), (1, START + timedelta(60), START + timedelta(90)), (2, START + timedelta(1), START + timedelta(129))]
    memb = spark.createDataFrame(spells, "permno int, mbrstartdt date, mbrenddt date")
    elig = {(r["window_id"], r["permno"]) for r in windows.window_eligibility(memb, cal, 60, 21).collect()}
    assert elig == {(0, 1), (1, 1), (1, 2), (2, 2), (3, 2)}
    assert (0, 2) in {(r["window_id"], r["permno"]) for r in windows.window_eligibility(memb, cal, 60, 21, 0.9).collect()}
    assert windows.hopping_windows(cal, 200, 21).count() == 0


def test_labels(spark, tmp_path):
    w = spark.createDataFrame([(0, date(2005, 1, 1), date(2005, 3, 31)), (1, date(2008, 9, 1), date(2008, 11, 30)), (2, date(2013, 1, 1), date(2013, 3, 31))], "window_id int, win_start date, win_end date")
    kind = lambda df: [r["regime"] for r in df.orderBy("window_id").collect()]
    assert kind(labels.label_windows(w)) == ["calm"] * 3 and kind(labels.label_windows(w, "other")) == ["calm"] * 3
    for built_in in ("nber", "NBER", "nber:builtin"):
        assert kind(labels.label_windows(w, built_in)) == ["calm", "crisis", "calm"]
    spark.createDataFrame([("2013-03-31", "2014-01-01")], "start string, end string").write.option("header", True).csv(str(tmp_path / "spans.csv"))
    assert kind(labels.label_windows(w, str(tmp_path / "spans.csv"))) == ["calm", "calm", "crisis"]
    none = labels.taxonomy(spark, str(tmp_path / "missing.csv"))
    assert none.count() == 0 and none.columns == labels.taxonomy(spark).columns and labels.tag_windows(w, none).filter("crisis_types = 'none'").count() == 3
    days = [date(2005, 1, 1) + timedelta(d) for d in range(0, 3100, 3)]
    vix = spark.createDataFrame([(d, "45" if d.year == 2008 else "15") for d in days] + [(date(2013, 1, 2), "bad")], "Date date, VIX string")
    for kw in ({}, {"threshold": 30.0}, {"how": "median"}, {"how": "max"}):
        assert kind(labels.label_windows(w, vix, **kw)) == ["calm", "crisis", "calm"]
    span = spark.createDataFrame([("2013-03-31", "2014-01-01")], "start string, END string")
    assert kind(labels.label_windows(w, span)) == ["calm", "calm", "crisis"]
    tags = labels.tag_windows(w, labels.taxonomy(spark)).orderBy("window_id").collect()
    assert tags[0]["crisis_names"] == "none" and tags[1]["crisis_names"] == "Global Financial Crisis" and tags[1]["crisis_types"] == "financial"


def test_sweep_and_reliability(spark):
    rows, bounds = set_up(spark, make_panel(spark, 6, 200, 5), 120)
    lab = labels.label_windows(bounds)
    s = {r["theta_q"]: r for r in sweep.threshold_sweep(rows, lab, 120, (0.5, 0.75), 5, 2).collect()}
    assert s.keys() == {0.5, 0.75} and all(r["n_valid_relaxed"] >= r["n_valid"] for r in s.values()) and s[0.5]["n_valid"] >= s[0.75]["n_valid"]
    weights = sweep.split_half_weights(rows, 120, 3)
    assert {r["half"] for r in weights.select("half").distinct().collect()} == {"a", "b"}
    for r in sweep.split_half_reliability(weights, bounds).collect():
        assert r["reliability_halfsplit"] is None or -1 <= r["reliability_halfsplit"] <= 1


def test_histogram_edges(spark):
    edges = aggregates.edges_of((0.0, 4.0, 80))
    values = [k / 20 for k in range(-3, 90)] + [1 / 3, 2 / 3, 4.0, None]
    df = spark.createDataFrame([(v, "g") for v in values], "v double, g string")
    got = [r["count"] for r in aggregates.histogram(df, "v", edges, "g").orderBy("bin_left").collect()]
    assert got == np.histogram([v for v in values if v is not None], edges)[0].tolist()


def test_nulls(spark):
    rows, bounds = set_up(spark, make_panel(spark, 4, 60, 7, gaps=True), 60)
    stats = pairs.pair_window_stats(rows, bounds, 60, 3).persist()
    again = [nulls.classical_null(stats.repartition(n), rows, 3).orderBy("permno_a", "permno_b").collect() for n in (1, 3)]
    assert again[0] == again[1] and len(again[0]) == exogenous.generator_fit(stats, rows, 3).count() > 0
    p = nulls.permutation_placebo(stats, rows, 3, n_perm=2)
    kept = {(r["permno_a"], r["permno_b"]): [r[f"N{c}"] for c in scores.CELLS] for r in stats.filter("valid").collect()}
    assert all([r[f"N{c}"] for c in scores.CELLS] == kept[r["permno_a"], r["permno_b"]] for r in p.collect()) and p.count() == 2 * len(kept)
    m = nulls.max_stat_null(stats, rows, 40).collect()
    assert len(m) == 1 and m[0]["n_pairs"] == len(kept)
    s = {r["N"]: r["s_odd_mean"] for r in nulls.small_sample_null(spark.createDataFrame([(10,), (200,)], "N int"), 500).collect()}
    assert s[10] > s[200]
    assert 0 <= nulls.finite_n_floor(3, 500) <= 1 and nulls.matched_floor(stats.filter("valid"), ["regime"]).count() == 1


def test_simulator_recovers_a_contextual_box():
    c = 0.8
    fit = {f"scale_{leg}{k}": 1.0 + k for leg in "ab" for k in (0, 1)} | {f"p{leg}{x}": 0.5 for leg in "ab" for x in scores.CELLS} | {f"rho{x}": -c if x == "11" else c for x in scores.CELLS}
    ra, rb = nulls.simulate_returns({k: np.array([v, v]) for k, v in fit.items()}, np.array([20_000, 15_000]), np.array([1, 77]))
    assert np.isnan(ra[1, 15_000:]).all() and np.isfinite(ra[1, :15_000]).all()
    got = nulls.pair_stats(ra, rb, 10)
    for i in range(2):
        assert got["valid"][i] and got["delta"][i] < 0.12 and abs(got["s_odd"][i] - 4 * c) < 0.15 and abs(got["ctx"][i] - (4 * c - 2)) < 0.2


def test_draws_are_even_and_independent():
    """Numbers of a stream, of neighbouring streams and of neighbouring counters."""
    u = draws.uniforms(draws.base("a", 1), np.arange(200_000))
    assert abs(u.mean() - 0.5) < 0.003 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01
    assert np.abs(np.histogram(u, 100, (0, 1))[0] / 2000 - 1).max() < 0.12
    first = draws.uniforms(np.array([draws.base("a", k) for k in range(20_000)]), 0)
    assert abs(first.mean() - 0.5) < 0.01 and abs(np.corrcoef(first[:-1], first[1:])[0, 1]) < 0.03
    orders = draws.permutations(draws.base("p"), np.arange(30_000) * 3, 3)
    assert np.abs(np.unique(orders, axis=0, return_counts=True)[1] / 5000 - 1).max() < 0.06


def test_keyed_bases_agree_with_columns(spark):
    got = spark.range(3).select("id", draws.base_column(F.lit("x"), "id", F.lit(0)).alias("b")).collect()
    assert all(r["b"] == draws.base("x", r["id"], 0) for r in got)


def test_blocks_do_not_change_results(spark, monkeypatch):
    rows, bounds = set_up(spark, make_panel(spark, 7, 60, 3, gaps=True), 60)
    stats = pairs.pair_window_stats(rows, bounds, 60, 3).persist()
    key = lambda df: sorted(map(str, df.collect()))
    many = key(exogenous.generator_fit(stats, rows, 3)), key(nulls.max_stat_null(stats, rows, 20))
    monkeypatch.setattr(blocks, "BLOCKS", 1)
    assert many == (key(exogenous.generator_fit(stats, rows, 3)), key(nulls.max_stat_null(stats, rows, 20)))
    monkeypatch.setattr(nulls, "PERMUTED", 1)
    assert many[1] == key(nulls.max_stat_null(stats, rows, 20))
    assert nulls.classical_null(stats.limit(0), rows, 3).count() == nulls.classical_null(stats, rows.limit(0), 3).count() == 0


def test_one_replica_gives_a_mean(spark):
    rows, bounds = set_up(spark, make_panel(spark, 9, 60, 3), 60)
    stats = pairs.pair_window_stats(rows, bounds, 60, 2)
    ex = graphs.config_excess(stats, 0.3, 1).collect()
    assert ex and all(r["giant_frac_null_mean"] is None or (r["giant_frac_excess"] is not None and r["giant_frac_z"] is None) for r in ex)
    assert any(r["giant_frac_null_mean"] is not None for r in ex)


def test_exogenous_regime(spark):
    rows, bounds = set_up(spark, make_panel(spark, 3, 120, 2), 120)
    stats = pairs.pair_window_stats(rows, bounds, 120, 3)
    regime = rows.select("date").distinct().withColumn("x", F.dayofmonth("date") % 2)
    got = exogenous.exogenous_contrast(stats, rows, regime, 5).collect()
    assert len(got) == 3 and all(r["valid_diag"] and np.isclose(r["dcmov"], r["E00"] - r["E11"]) for r in got)


def test_graph_kernels():
    clique = lambda vs: [(a, b, 1.0) for a, b in itertools.combinations(vs, 2)]
    two = clique(range(5)) + clique(range(5, 10)) + [(0, 5, 1.0)]
    found = graphs.greedy_communities(10, two)
    assert len(set(found)) == 2 and len(set(found[:5])) == 1
    assert np.isclose(graphs.modularity(two, found), 2 * (10 / 21 - (21 / 42) ** 2))
    n, m, dens, clus, giant, q, k = graphs.graph_metrics(11, two)
    assert (n, m, k) == (11, 21, 3) and np.isclose(giant, 10 / 11) and clus > 0.8
    assert graphs.graph_metrics(4, []) == (4, 0, 0.0, 0.0, 0.25, 0.0, 4)
    ring = [(i, (i + 1) % 10, 1.0) for i in range(10)]
    new = graphs.rewired(10, ring, 7)
    degrees = lambda e: np.bincount([v for i, j, _ in e for v in (i, j)], minlength=10).tolist()
    assert degrees(new) == degrees(ring) and len({frozenset(x[:2]) for x in new}) == 10 and {frozenset(x[:2]) for x in new} != {frozenset(x[:2]) for x in ring}
    diff, p, *_ = graphs.permutation_difference(np.arange(10.0) + 5, np.arange(10.0), 2000, 0)
    assert diff == 5 and p < 0.01


def test_networks_of_planted_blocks(spark):
    rng = np.random.default_rng(0)
    rows = []
    for w in range(4):
        for a, b in itertools.combinations(range(30), 2):
            e = float((0.6 if a // 10 == b // 10 else 0.0) + rng.normal(0, 0.05))
            rows.append((w, START + timedelta(w), START + timedelta(w + 60), a, b, e, e, e, e, 15, 15, 15, 15, 1.0 + 2 * e, True, "crisis" if w in (1, 2) else "calm"))
    cols = "window_id int, win_start date, win_end date, permno_a int, permno_b int, E00 double, E01 double, E10 double, E11 double, N00 long, N01 long, N10 long, N11 long, s_odd double, valid boolean, regime string"
    stats = spark.createDataFrame(rows, cols).persist()
    m = graphs.network_metrics(stats, 0.1, 2.0, labels.taxonomy(spark)).toPandas()
    top = m[m["graph"] != "s_odd_abs"]
    assert len(m) == 16 and top["n_edges"].nunique() == 1 and (top["n_nodes"] == 30).all() and top["modularity"].min() > 0.4
    q = graphs.qap_hierarchy(stats, n_perm=19, max_windows=2).toPandas()
    assert len(q) == 2 and (q["p_e00_s_odd"] <= 0.1).all() and (q["gate_r2_s_odd_on_pooled_e00"] > 0.9).all()
    ex = graphs.config_excess(stats, 0.1, 3, episodes=labels.taxonomy(spark))
    assert ex.count() == 12 and graphs.window_inference(ex, n_perm=200).filter("contrast = 'crisis_vs_calm'").count() == 3


ORACLES = ["panel_returns", "window_eligibility", "pair_window_stats", "pair_window_stats_w120", "headline_rates", "stat_hist", "taxonomy_tags", "split_half_reliability", "generator_fit", "graph_clustering"]


@pytest.mark.parametrize("name", ORACLES)
def test_queries_agree_with_sql(spark, name):
    from quadrille.plans.oracles import ORACLE_SQL
    from quadrille.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, d).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def text(df):
        df = df[sorted(df.columns)].astype(object)
        show = lambda v: "none" if v is None or v != v else f"{float(v):.9f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10]
        return sorted(tuple(map(show, row)) for row in df.itertuples(index=False))

    assert text(got) == text(want)

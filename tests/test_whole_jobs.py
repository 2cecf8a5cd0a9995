"""Registered queries do the operators' whole job."""

import pytest

from quadrille.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def panel(spark):
    return queries.Panel(spark, SF)


def test_qap_queries_take_every_window(spark, panel):
    windows = {r["window_id"] for r in panel.stats.filter("valid").select("window_id").distinct().collect()}
    got = queries.QUERIES["qap_permutation"](spark, SF).toPandas()
    assert len(windows) > 8 and set(got["window_id"]) == windows
    assert (got["p_e00_s_odd"].dropna() * 200).round(6).mod(1).eq(0).all()  # 199 permutations
    tiers = queries.QUERIES["tier_summary"](spark, SF).first()
    assert abs(tiers["r_e00_s_odd_mean"] - got["r_e00_s_odd"].mean()) < 1e-6
    assert queries.QUERIES["gate_summary"](spark, SF).first()["n_gate_windows"] == len(windows)


def test_sweep_null_takes_every_quantile_and_regime(spark, panel, monkeypatch):
    from quadrille.operators import nulls, sweep

    swept = sweep.sweep_pairs(panel.rows, panel.width, sweep.RELAXED_QUANTILES, queries.N_MIN_LOW).join(panel.labels, "window_id").filter("valid")
    want = {(r["theta_q"], r["regime"]) for r in swept.select("theta_q", "regime").distinct().collect()}
    got = queries.QUERIES["sweep_null_rates"](spark, SF).collect()
    assert ("crisis" in {g for _, g in want}) and {(r["theta_q"], r["regime"]) for r in got} == want
    seen = {}

    def spy(s, rows, quantiles, n_min, cap=3000, seed=0):
        seen.update(quantiles=quantiles, cap=cap, regimes={r["regime"] for r in s.select("regime").distinct().collect()})
        return rows

    monkeypatch.setattr(nulls, "sweep_null_rates", spy)
    queries.QUERIES["sweep_null_rates"](spark, SF)
    assert seen == {"quantiles": (0.90, 0.95), "cap": 3000, "regimes": {"calm", "crisis"}}


def test_sampling_queries_use_the_operators_defaults(spark, panel, monkeypatch):
    from quadrille.operators import nulls

    low = queries.Panel(spark, SF, n_min=queries.N_MIN_LOW)
    valid = low.stats.filter("valid").count()
    assert queries.QUERIES["scatter_quota"](spark, SF).count() == min(valid, 20_000) > 300
    floors = {r["n_min"]: r["floor"] for r in queries.QUERIES["finite_n_floor"](spark, SF).collect()}
    sizes = {min(r[f"N{c}"] for c in ("00", "01", "10", "11")) for r in low.stats.filter("valid").collect()}
    assert len(sizes) > 4 and floors == {n: round(nulls.finite_n_floor(n), 9) for n in sizes}
    seen = []
    monkeypatch.setattr(nulls, "max_stat_null", lambda stats, rows, n_perm=200: seen.append(n_perm) or rows)
    monkeypatch.setattr(queries.graphs, "config_excess", lambda stats, n_rewire=20, episodes=None: seen.append(n_rewire) or stats)
    monkeypatch.setattr(queries.graphs, "window_inference", lambda excess, n_perm=20_000: seen.append(n_perm) or excess)
    for name in ("max_stat_null", "config_excess", "window_inference"):
        queries.QUERIES[name](spark, SF)
    assert seen == [200, 20, 20, 20_000]

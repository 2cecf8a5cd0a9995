"""Regimes known beforehand, weights, share classes, semi-partialling, tiles and selection, against plain loops."""

import itertools
import random
from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import scores
from quadrille.operators import aggregates, contexts, graphs, pairs, screening, selection
from quadrille.plans import queries, specified
from tests.test_engine import START, make_panel, set_up


def day(k):
    return START + timedelta(k)


def test_lagged_volatility_uses_earlier_days_only(spark):
    panel = [(1, k, r) for k, r in enumerate((0.1, None, -0.2, 0.3, 0.0, 0.5))] + [(2, 0, 9.0)]
    rows = spark.createDataFrame([(p, day(k), r) for p, k, r in panel] + [(1, day(3), 0.3)], "permno int, date date, ret double")
    got = {(r["permno"], r["date"]): r["vol"] for r in contexts.lagged_volatility(rows, days=2, least=2).collect()}
    root = lambda *v: pytest.approx(np.sqrt(np.mean(np.square(v))))
    assert got == {(1, day(0)): None, (1, day(2)): None, (1, day(3)): root(0.1, -0.2), (1, day(4)): root(-0.2, 0.3), (1, day(5)): root(0.3, 0.0), (2, day(0)): None}


def test_lagged_pairs_agree_with_loops(spark):
    panel = make_panel(spark, 4, 80, 11, gaps=True)
    rows, _ = set_up(spark, panel.filter(F.col("date") >= day(15)), 60)
    got = {(r["window_id"], r["permno_a"], r["permno_b"]): r for r in contexts.lagged_pair_stats(rows, panel, 60, 2, 0.5, 10, 5).collect()}
    series = {}
    for r in panel.orderBy("date").collect():
        if r["ret"] is not None:
            series.setdefault(r["permno"], []).append((r["date"], r["ret"]))
    vol = {(p, d): np.sqrt(np.mean([x * x for _, x in s[max(0, k - 10) : k]])) for p, s in series.items() for k, (d, _) in enumerate(s) if k >= 5}
    legs = {}
    for r in rows.collect():
        if r["ret"] is not None and (r["permno"], r["date"]) in vol:
            legs.setdefault((r["window_id"], r["permno"]), {})[r["date"]] = (vol[r["permno"], r["date"]], r["ret"])
    assert any(r["date"] == day(15) for r in rows.collect()) and (1, day(15)) in vol  # the frame reaches back before the window
    for (w, a), (v, b) in itertools.combinations(sorted(legs), 2):
        if w != v:
            continue
        bar = {p: np.quantile([x for x, _ in legs[w, p].values()], 0.5) for p in (a, b)}
        n = dict.fromkeys(scores.CELLS, 0)
        for d in legs[w, a].keys() & legs[w, b].keys():
            (va, ra), (vb, rb) = legs[w, a][d], legs[w, b][d]
            if ra and rb:
                n[f"{int(va < bar[a])}{int(vb < bar[b])}"] += 1
        assert [got[w, a, b][f"N{c}"] for c in scores.CELLS] == list(n.values())


def test_events_roll_onto_trading_days(spark):
    """Closed days, several events on one day, events before the first day and after the last one."""
    calendar = spark.createDataFrame([(day(k),) for k in (0, 1, 4, 5, 6, 9)], "date date")
    events = spark.createDataFrame([(day(k),) for k in (-3, 0, 2, 2, 3, 4, 7, 10)] + [(None,)], "date date")
    assert {r["date"]: r["n_events"] for r in contexts.rolled_events(events, calendar).collect()} == {day(0): 2, day(4): 4, day(9): 1}
    x = lambda b, a: [r["x"] for r in contexts.event_regime(calendar, events, b, a).orderBy("date").collect()]
    assert x(0, 0) == [0, 1, 0, 1, 1, 0] and x(0, 1) == [0, 0, 0, 0, 1, 0] and x(1, 0) == [0, 0, 0, 1, 0, 0]
    assert [r["x"] for r in contexts.event_regime(calendar, events.limit(0)).collect()] == [1] * 6
    assert contexts.event_regime(calendar.limit(0), events).collect() == []


def test_trading_weights(spark):
    """A missing volume is thin; the frame holds the member's own last rows."""
    rows = [(1, k, v) for k, v in enumerate((5, None, 0, 9, 9, 9))] + [(2, 0, 1)]
    df = spark.createDataFrame([(p, day(k), v) for p, k, v in rows], "permno int, date date, vol long")
    got = {(r["permno"], r["date"]): (r["weight"], r["thin"]) for r in screening.trading_weights(df, 3, 3).collect()}
    assert [got[1, day(k)] for k in range(6)] == [(3, False), (1, True), (1, True), (1, False), (2, False), (3, False)] and got[2, day(0)] == (0, True)


def test_weighted_pairs_agree_with_loops(spark, monkeypatch):
    panel = make_panel(spark, 4, 70, 5, gaps=True)
    rows, bounds = set_up(spark, panel, 70)
    rng = random.Random(2)
    weights = {(p, k): (rng.randrange(4), rng.random() < 0.25) for p in range(1, 5) for k in range(65)}
    df = spark.createDataFrame([(p, day(k), w, t) for (p, k), (w, t) in weights.items()], "permno int, date date, weight int, thin boolean")
    got = screening.weighted_pair_stats(rows, df, 70, 2).collect()
    legs = {}
    for r in pairs.with_regimes(rows).collect():
        legs.setdefault(r["permno"], {})[r["date"]] = (r["x"], np.sign(r["ret"]), *weights.get((r["permno"], (r["date"] - START).days), (0, True)))
    assert len(got) == 6
    for r in got:
        a, b = legs[r["permno_a"]], legs[r["permno_b"]]
        for c in scores.CELLS:
            days = [d for d in a.keys() & b.keys() if a[d][1] and b[d][1] and f"{a[d][0]}{b[d][0]}" == c]
            w = [a[d][2] * b[d][2] for d in days]
            assert (r[f"N{c}"], r[f"W{c}"]) == (len(days), sum(w))
            for name, v in (("E", [a[d][1] * b[d][1] for d in days]), ("a", [a[d][1] for d in days]), ("b", [b[d][1] for d in days])):
                assert r[f"{name}{c}"] == (pytest.approx(np.dot(w, v) / sum(w)) if sum(w) else None)
        assert r["thin_a"] == (np.mean([v[3] for v in a.values()]) > 0.25) and r["valid"] == (min(r[f"N{c}"] for c in scores.CELLS) >= 2 and min(r[f"W{c}"] for c in scores.CELLS) > 0)
    # weight 1 everywhere is the plain pair table
    ones = df.select("permno", "date").union(spark.createDataFrame([(p, day(k)) for p in range(1, 5) for k in range(65, 70)], "permno int, date date")).select("*", F.lit(1).alias("weight"), F.lit(False).alias("thin"))
    plain = {r["permno_a"] * 10 + r["permno_b"]: r["ctx"] for r in pairs.pair_window_stats(rows, bounds, 70, 2).collect()}
    assert {r["permno_a"] * 10 + r["permno_b"]: r["ctx"] for r in screening.weighted_pair_stats(rows, ones, 70, 2).collect()} == pytest.approx(plain)


def test_one_class_per_firm(spark):
    """Overlapping spells, open ends, ties of volume, members without a company, a company that changes between windows."""
    days = [(day(k),) for k in range(20)]
    calendar = spark.createDataFrame(days, "date date")
    windows = [(w, day(10 * w), day(10 * w + 9)) for w in (0, 1)]
    elig = spark.createDataFrame([(*w, p) for w in windows for p in (1, 2, 3, 4, 5)], "window_id int, win_start date, win_end date, permno int")
    spells = [(1, 7, day(0), day(30)), (2, 7, day(0), None), (3, 7, day(0), day(12)), (3, 8, day(9), day(30)), (4, 9, day(0), day(5)), (4, 3, day(15), day(30)), (4, 2, day(15), day(30))]
    spells = spark.createDataFrame(spells, "permno int, permco int, start date, end date")
    volumes = [(1, 3, 10), (2, 3, 4), (2, 5, 6), (3, 2, 50), (1, 12, 1), (2, 13, 3)]
    volumes = spark.createDataFrame([(p, day(k), v) for p, k, v in volumes], "permno int, date date, vol long")
    firms = {(r["window_id"], r["permno"]): r["firm"] for r in screening.firm_of_members(elig, spells).collect()}
    assert [firms[0, p] for p in range(1, 6)] == [7, 7, 8, None, None] and [firms[1, p] for p in range(1, 6)] == [7, 7, 8, 2, None]
    kept = screening.one_class_per_firm(elig, spells, volumes, calendar, 10, 10).collect()
    assert sorted((r["window_id"], r["permno"]) for r in kept) == [(0, 1), (0, 3), (0, 4), (0, 5), (1, 2), (1, 3), (1, 4), (1, 5)]
    assert screening.one_class_per_firm(elig, spells.limit(0), volumes.limit(0), calendar, 10, 10).count() == 10


def test_semi_partialling_against_regressions():
    """Coefficient, t and p by full least squares; a predictor that is known to the other one has no t."""
    rng = np.random.default_rng(8)
    n, perms = 14, 60
    symmetric = lambda m: (m + m.T) / 2
    other = symmetric(rng.normal(size=(n, n)))
    x = symmetric(rng.normal(size=(n, n))) + 0.7 * other
    y = 0.3 * x - 0.5 * other + symmetric(rng.normal(size=(n, n)))
    for m, cell in ((y, (0, 3)), (x, (2, 5)), (other, (1, 9))):
        m[cell] = m[cell[::-1]] = np.nan
    up = np.triu_indices(n, 1)

    def t_of(v, e, o):
        ok = np.isfinite(v) & np.isfinite(e) & np.isfinite(o)
        design = np.column_stack([np.ones(ok.sum()), e[ok], o[ok]])
        beta = np.linalg.lstsq(design, v[ok], rcond=None)[0]
        rest = v[ok] - design @ beta
        return beta[1], beta[1] / np.sqrt(rest @ rest / (ok.sum() - 3) * np.linalg.inv(design.T @ design)[1, 1])

    beta, t, p = graphs.partialled(y, x, other, perms, 99)
    want = t_of(y[up], x[up], other[up])
    assert (beta, t) == pytest.approx(want)
    ok = np.isfinite(y[up]) & np.isfinite(x[up]) & np.isfinite(other[up])
    e = np.full((n, n), np.nan)
    design = np.column_stack([np.ones(ok.sum()), other[up][ok]])
    e[up[0][ok], up[1][ok]] = x[up][ok] - design @ np.linalg.lstsq(design, x[up][ok], rcond=None)[0]
    e = np.where(np.isfinite(e), e, e.T)
    got = [t_of(y[up], e[np.ix_(o, o)][up], other[up])[1] for o in graphs.permutations(99, np.arange(perms) * n, n)]
    assert p == pytest.approx((1 + sum(abs(v) >= abs(t) for v in got)) / (perms + 1))
    assert all(np.isnan(graphs.partialled(y, 2 * other + 1, other, 5, 1))) and all(np.isnan(graphs.partialled(y[:3, :3], x[:3, :3], other[:3, :3], 5, 1)))


def test_tiles_bound_what_a_task_makes(spark, monkeypatch):
    """Members of one window grow tenfold: the pairs of the widest key do not."""
    monkeypatch.setattr(pairs, "TILE", 20)
    widest = []
    for n in (15, 150):
        legs = spark.range(n).select(F.lit(1).alias("window_id"), F.col("id").cast("int").alias("permno")).union(spark.createDataFrame([(2, 5), (2, 9), (3, 1)], "window_id int, permno int"))
        met = pairs.legs_by_window(legs)
        seen = sorted((r["w"], r["a"], r["b"]) for r in met.select(F.col("l.window_id").alias("w"), F.col("l.permno").alias("a"), F.col("r.permno").alias("b")).collect())
        assert seen == [*((1, *c) for c in itertools.combinations(range(n), 2)), (2, 5, 9)]
        widest.append(met.groupBy("l.window_id", "l.tile", "l.other").count().agg(F.max("count")).first()[0])
    assert widest == [105, 400]


@pytest.mark.parametrize("last", [selection.LAST, 5])
def test_exact_quantiles(spark, monkeypatch, last):
    """Equal to percentile for ties, outliers, one value and none; also where every pass leaves a few rows only."""
    monkeypatch.setattr(selection, "LAST", last)
    monkeypatch.setattr(selection, "CELLS", 8)
    rng = np.random.default_rng(4)
    for values in ([*rng.normal(size=300), 1e9, *[0.25] * 200], [7.0] * 50, [3.0], [1.0, 2.0], [*np.arange(40.0), None]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(4)
        for q in (0.0, 0.37, 0.5, 0.999, 1.0):
            assert selection.exact_quantile(df, F.col("v"), q) == pytest.approx(df.agg(F.percentile("v", q)).first()[0], rel=1e-14)
    assert selection.exact_quantile(df.limit(0), F.col("v"), 0.5) is None
    assert aggregates.return_histogram(spark.createDataFrame([], "permno int, date date, ret double")).collect() == []


def test_bottom_k_keeps_the_rows_of_a_ranked_sort(spark):
    """Groups smaller and larger than k, null groups, equal digests."""
    df = spark.range(4000).select(F.when(F.col("id") % 7 == 0, None).when(F.col("id") < 3900, "big").otherwise("small").alias("g"), (F.col("id") % 1500).alias("k"), "id")
    got = selection.bottom_k(df, 300, ["g"], F.md5(F.col("k").cast("string")), "id")
    from pyspark.sql import Window

    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.col("k").cast("string")), "id"))).filter("r <= 300").drop("r")
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert selection.bottom_k(df.limit(0), 3, ["g"], F.md5("g"), "id").count() == 0


@pytest.mark.parametrize("name", sorted(specified.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(specified.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) > 0
    text = lambda v: "-" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)[:10]
    assert sorted([text(v) for v in r] for r in got[cols].itertuples(index=False)) == sorted([text(v) for v in r] for r in want[cols].itertuples(index=False))



"""Simulation and permutation nulls. Every draw comes from its own keys and counters, so results do not depend on the layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS, pair_arrays
from .aggregates import BINS, edges_of, group_sample, histogram, sample_pairs
from .blocks import PAIR_KEYS, masked_quantile, on_pairs
from .draws import base, base_column, uniforms
from .exogenous import fit_pairs
from .pairs import valid_pairs

_STATS = ", ".join(f"{v}{c} double" for v in ("E", "a", "b") for c in CELLS) + ", " + ", ".join(f"N{c} long" for c in CELLS) + ", s_odd double, delta double, ctx double, valid boolean"
_KEYS = "window_id int, permno_a int, permno_b int"
#: Numbers that a permutation kernel holds at once.
PERMUTED = 4_000_000


def draw_signs(pa: np.ndarray, pb: np.ndarray, rho: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signs with these chances of + and this correlation, as far as they can hold together, from uniform numbers."""
    both = pa * pb + rho * np.sqrt(pa * (1 - pa) * pb * (1 - pb))
    p = np.clip([both, pa - both, pb - both, 1 - pa - pb + both], 0, None)
    whole = p.sum(axis=0)
    p = np.where(whole > 0, p / np.where(whole > 0, whole, 1), 0.25)
    k = sum((u >= x).astype(int) for x in np.cumsum(p, axis=0)[:3])
    return np.where(k < 2, 1.0, -1.0), np.where(k % 2 == 0, 1.0, -1.0)


def simulate_returns(fit: dict[str, np.ndarray], days: np.ndarray, bases: np.ndarray, q: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Two series for each fitted pair: exponential magnitudes in fair-coin states, signs by cell of the split magnitudes.

    Pairs are rows; days that a pair does not have are NaN. Five numbers are drawn for each day: state and magnitude of either leg, signs.
    """
    width = int(days.max()) if len(days) else 0
    live = np.arange(width) < days[:, None]
    u = uniforms(np.asarray(bases)[:, None, None], np.arange(width)[:, None] * 5 + np.arange(5))
    mags, regimes = [], []
    for j, leg in enumerate("ab"):
        scale = np.maximum(np.stack([fit[f"scale_{leg}0"], fit[f"scale_{leg}1"]], axis=1), 1e-12)
        m = -np.take_along_axis(scale, (u[..., 2 * j] >= 0.5).astype(int), axis=1) * np.log(u[..., 2 * j + 1])
        mags.append(np.where(live, m, np.nan))
        regimes.append((m < masked_quantile(m, live, q)).astype(int))
    cell = 2 * regimes[0] + regimes[1]
    by_cell = [np.take_along_axis(np.stack([fit[f"{v}{c}"] for c in CELLS], axis=1), cell, axis=1) for v in ("pa", "pb", "rho")]
    a, b = draw_signs(*by_cell, u[..., 4])
    return a * mags[0], b * mags[1]


def pair_stats(ra: np.ndarray, rb: np.ndarray, n_min: int, q: float = 0.5) -> dict[str, np.ndarray]:
    """Columns of _STATS for pairs of return series; each threshold is over its leg's own days."""
    with np.errstate(invalid="ignore"):
        x, y = ((np.abs(r) < masked_quantile(np.abs(r), np.isfinite(r), q)).astype(int) for r in (ra, rb))
    n, e, a, b, s, d, c = pair_arrays(np.sign(ra), np.sign(rb), x, y)
    ok = n.min(axis=0) >= n_min
    out = {f"{v}{k}": values[i] for v, values in (("E", e), ("a", a), ("b", b), ("N", n)) for i, k in enumerate(CELLS)}
    return out | {k: np.where(ok, v, np.nan) for k, v in (("s_odd", s), ("delta", d), ("ctx", c))} | {"valid": ok}


def classical_null(stats: DataFrame, rows: DataFrame, n_min: int = 10, max_pairs: int | None = None, seed: int = 0, q: float = 0.5) -> DataFrame:
    """The pair table of one simulated run for each valid pair, from its fitted generator.

    A run has as many days as the two legs have between them.
    """
    pairs = sample_pairs(stats, max_pairs, seed) if max_pairs is not None else valid_pairs(stats)
    pairs = pairs.select(*PAIR_KEYS, "regime").withColumn("base", base_column(F.lit("null"), *PAIR_KEYS, F.lit(seed)))

    def kernel(pairs, a, b):
        joint, fit = fit_pairs(a, b, n_min, q)
        ready = joint >= 4 * n_min
        if ready.any():
            days = (np.isfinite(a) | np.isfinite(b)).sum(axis=1)[ready]
            ra, rb = simulate_returns({k: v[ready] for k, v in fit.items()}, days, pairs["base"].to_numpy()[ready], q)
            kept = pairs[ready].reset_index(drop=True)
            yield pd.DataFrame({**{k: kept[k] for k in (*PAIR_KEYS, "regime")}, **pair_stats(ra, rb, n_min, q)})

    return on_pairs(pairs, rows, kernel, f"{_KEYS}, regime string, {_STATS}").withColumn("source", F.lit("classical_null"))


def streamed_null_histogram(stats: DataFrame, rows: DataFrame, per_window: int = 400, n_min: int = 10, seed: int = 0, q: float = 0.5) -> DataFrame:
    """Histogram of ctx of the classical null, from a sample of each window's valid pairs; windows add up."""
    chosen = group_sample(valid_pairs(stats), per_window, ["window_id"], ("permno_a", "permno_b"), seed)
    return histogram(classical_null(chosen, rows, n_min, seed=seed, q=q).filter("valid"), "ctx", edges_of(BINS["ctx"]))


def _permuted(a: np.ndarray, b: np.ndarray, bases: np.ndarray, perms: int, q: float):
    """(pair_arrays of so many joint permutations of the regimes against the signs, pairs that have joint days).

    The i-th joint day of a pair takes the regimes of the one that its i-th least number belongs to. Thresholds are over each leg's
    own days.
    """
    joint = np.isfinite(a) & np.isfinite(b) & (a != 0) & (b != 0)
    with np.errstate(invalid="ignore"):
        x, y = ((np.abs(r) < masked_quantile(np.abs(r), np.isfinite(r), q)).astype(int) for r in (a, b))
    order = np.argsort(~joint, axis=1, kind="stable")
    take = lambda v: np.take_along_axis(v, order, axis=1)
    live, x, y = take(joint), take(x), take(y)
    sa, sb = (np.where(live, np.sign(take(r)), np.nan) for r in (a, b))
    width = a.shape[1]
    numbers = uniforms(bases[:, None, None], np.arange(perms)[:, None] * width + np.arange(width))
    places = np.argsort(np.where(live[:, None, :], numbers, 2.0), axis=2, kind="stable")
    xs, ys = (np.take_along_axis(np.broadcast_to(v[:, None, :], places.shape), places, axis=2) for v in (x, y))
    return pair_arrays(sa[:, None, :], sb[:, None, :], xs, ys), joint.any(axis=1)


def _chunk(perms: int, width: int) -> int:
    return max(1, PERMUTED // max(1, perms * width))


def permutation_placebo(stats: DataFrame, rows: DataFrame, n_min: int = 10, n_perm: int = 1, seed: int = 0, max_pairs: int | None = None, q: float = 0.5, width: int = 60) -> DataFrame:
    """window_id, pair, perm, N, s_odd, delta, ctx, valid with both legs' regimes shuffled together."""
    pairs = (sample_pairs(stats, max_pairs, seed) if max_pairs is not None else valid_pairs(stats)).select(*PAIR_KEYS).withColumn("base", base_column(F.lit("perm"), *PAIR_KEYS, F.lit(seed)))

    def kernel(pairs, a, b):
        (n, _, _, _, s, d, c), some = _permuted(a, b, pairs["base"].to_numpy(), n_perm, q)
        ok = n.min(axis=0) >= n_min
        for p in range(n_perm):
            scores = {k: np.where(ok[:, p], v[:, p], np.nan) for k, v in (("s_odd", s), ("delta", d), ("ctx", c))}
            yield pd.DataFrame({**{k: pairs[k] for k in PAIR_KEYS}, "perm": p, **{f"N{k}": n[i, :, p] for i, k in enumerate(CELLS)}, **scores, "valid": ok[:, p]})[some]

    return on_pairs(pairs, rows, kernel, f"{_KEYS}, perm int, {', '.join(f'N{c} long' for c in CELLS)}, s_odd double, delta double, ctx double, valid boolean", _chunk(n_perm, width))


def max_stat_null(stats: DataFrame, rows: DataFrame, n_perm: int = 200, alpha: float = 0.05, seed: int = 0, max_pairs_per_window: int | None = None, q: float = 0.5, width: int = 60) -> DataFrame:
    """Family-wise threshold of ctx in each window: quantile over permutations of the largest ctx among its pairs.

    Pairs are permuted where they are; only the maxima, one for each block and permutation, are shuffled.
    """
    pairs = valid_pairs(stats)
    if max_pairs_per_window is not None:
        pairs = group_sample(pairs, max_pairs_per_window, ["window_id"], ("permno_a", "permno_b"), seed)
    keyed = pairs.select(*PAIR_KEYS).withColumn("base", base_column(F.lit("perm"), *PAIR_KEYS, F.lit(seed)))

    def kernel(pairs, a, b):
        c = _permuted(a, b, pairs["base"].to_numpy(), n_perm, q)[0][-1]
        best = np.where(np.isfinite(c), c, -np.inf).max(axis=0)
        yield pd.DataFrame({"window_id": pairs["window_id"].iloc[0], "perm": np.arange(n_perm), "m": best})[np.isfinite(best)]

    top = on_pairs(keyed, rows, kernel, "window_id int, perm int, m double", _chunk(n_perm, width)).groupBy("window_id", "perm").agg(F.max("m").alias("m"))
    bar = top.groupBy("window_id").agg(F.percentile("m", 1 - alpha).alias("ctx_threshold"))
    seen = pairs.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("ctx").alias("max_observed"))
    return seen.join(bar, "window_id").select("window_id", "n_pairs", "ctx_threshold", "max_observed")


def _fair_scores(sizes: np.ndarray, bases, first=0) -> tuple[np.ndarray, np.ndarray]:
    """s_odd and ctx of fair independent signs in cells of the given sizes, (runs, 4). One number for each day, cell after cell."""
    ends = np.cumsum(sizes, axis=1)
    width = int(ends[:, -1].max()) if len(sizes) else 0
    u = uniforms(np.broadcast_to(bases, len(sizes))[:, None], np.broadcast_to(first, len(sizes))[:, None] + np.arange(width))
    kind = np.floor(4 * u).astype(int)  # ++, +-, -+, --
    cell = (np.arange(width)[None, :, None] >= ends[:, None, :]).sum(axis=2)
    k = np.stack([np.stack([((cell == c) & (kind == v)).sum(axis=1) for v in range(4)], axis=1) for c in range(4)], axis=1)
    n = sizes.astype(float)
    e = (k[..., 0] + k[..., 3] - k[..., 1] - k[..., 2]) / n
    a, b = (k[..., 0] + k[..., 1] - k[..., 2] - k[..., 3]) / n, (k[..., 0] + k[..., 2] - k[..., 1] - k[..., 3]) / n
    s = np.abs(e.sum(axis=1, keepdims=True) - 2 * e).max(axis=1)
    d = abs(a[:, 0] - a[:, 1]) + abs(a[:, 2] - a[:, 3]) + abs(b[:, 0] - b[:, 2]) + abs(b[:, 1] - b[:, 3])
    return s, s - d - 2


def _fair_runs(n: int, n_sims: int, seed: int, tag: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [_fair_scores(np.full((min(1000, n_sims - k), 4), n), base(tag, n, seed), (k + np.arange(min(1000, n_sims - k))) * 4 * n) for k in range(0, n_sims, 1000)]
    s, c = zip(*parts, strict=True)
    return np.concatenate(s), np.concatenate(c)


def cell_sizes(pairs: DataFrame) -> DataFrame:
    """N: the sizes that the smallest cell of these pairs has, each once."""
    return pairs.select(F.least(*[F.col(f"N{c}") for c in CELLS]).cast("int").alias("N")).filter("N > 0").distinct()


def small_sample_null(sizes: DataFrame, n_sims: int = 2000, seed: int = 0) -> DataFrame:
    """Mean, 95 % quantile and share above 2 of s_odd for fair signs, for each size N of all four cells."""

    def run(frames):
        for f in frames:
            rows = []
            for n in f["N"].tolist():
                s, _ = _fair_runs(n, n_sims, seed, "small")
                rows.append((n, s.mean(), np.quantile(s, 0.95), s.mean() - 2, (s > 2 + 1e-9).mean()))
            yield pd.DataFrame(rows, columns=["N", "s_odd_mean", "s_odd_q95", "ctx_mean", "frac_sodd_gt2"])

    return sizes.select("N").mapInPandas(run, "N int, s_odd_mean double, s_odd_q95 double, ctx_mean double, frac_sodd_gt2 double")


def finite_n_floors(sizes: DataFrame, n_sims: int = 8000, seed: int = 0) -> DataFrame:
    """n_min, floor: share of ctx > 0 for fair signs, for each size N of all four cells."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(n, finite_n_floor(n, n_sims, seed)) for n in f["N"].tolist()], columns=["n_min", "floor"])

    return sizes.select("N").mapInPandas(run, "n_min int, floor double")


def finite_n_floor(n_min: int, n_sims: int = 8000, seed: int = 0) -> float:
    """Share of ctx > 0 for fair signs with n_min days in each cell."""
    return float((_fair_runs(n_min, n_sims, seed, "floor")[1] > 1e-9).mean())


def matched_floor(pairs: DataFrame, by: list[str], cap: int = 5000, seed: int = 0) -> DataFrame:
    """Share of ctx > 0 for fair signs in cells of the sizes of (at most cap of) each group's pairs."""
    chosen = group_sample(pairs, cap, by, PAIR_KEYS, seed).select(*by, *PAIR_KEYS, *[F.col(f"N{c}") for c in CELLS]).withColumn("base", base_column(F.lit("matched"), *PAIR_KEYS, F.lit(seed)))

    def run(frames):
        for f in frames:
            if len(f):
                sizes = f[[f"N{c}" for c in CELLS]].to_numpy().clip(min=1)
                yield f[by].assign(hit=(_fair_scores(sizes, f["base"].to_numpy())[1] > 1e-9).astype(float))

    kinds = {n: t for n, t in pairs.dtypes}
    return chosen.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", hit double").groupBy(*by).agg(F.avg("hit").alias("floor"))


def sweep_null_rates(swept: DataFrame, rows: DataFrame, quantiles, relaxed_n_min: int = 3, cap: int = 3000, seed: int = 0) -> DataFrame:
    """Rate of ctx > 0 of the classical null at each relaxed quantile and regime, from a sample of its valid pairs.

    A group whose simulated pairs are all invalid has a row with 0 of them and no rate.
    """
    out = None
    for q in quantiles:
        chosen = group_sample(swept.filter((F.col("theta_q") == float(q)) & F.col("valid")), cap, ["regime"], PAIR_KEYS, seed)
        null = classical_null(chosen, rows, relaxed_n_min, seed=seed, q=float(q))
        r = null.groupBy("regime").agg(F.avg(F.when(F.col("valid"), F.when(F.col("ctx") > 0, 1.0).otherwise(0.0))).alias("cbd_rate_null_relaxed"), F.count_if("valid").alias("n_valid_null_relaxed")).withColumn("theta_q", F.lit(float(q)))
        out = r if out is None else out.unionByName(r)
    return out


def null_gate_stats(stats: DataFrame, rows: DataFrame, n_windows: int | None = 6, n_nodes: int | None = 60, n_min: int = 10, q: float = 0.5, seed: int = 0) -> DataFrame:
    """The classical null on the first windows and, in each, the first members that valid pairs have (None: all)."""
    from .windows import first_windows

    ok = valid_pairs(stats) if n_windows is None else first_windows(valid_pairs(stats), n_windows)
    if n_nodes is None:
        return classical_null(ok, rows, n_min, seed=seed, q=q)
    nodes = ok.select("window_id", F.col("permno_a").alias("p")).union(ok.select("window_id", "permno_b")).distinct()
    nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy("window_id").orderBy("p"))).filter(F.col("r") <= n_nodes)
    for k in "ab":
        ok = ok.join(nodes.select("window_id", F.col("p").alias(f"permno_{k}")), ["window_id", f"permno_{k}"], "left_semi")
    return classical_null(ok, rows, n_min, seed=seed, q=q)

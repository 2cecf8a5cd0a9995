"""A regime from outside, shared by both legs, and the fit of a pair's classical generator."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS
from .blocks import PAIR_KEYS, masked_mean, masked_quantile, on_pairs
from .pairs import WORD, day_masks, valid_pairs

_KEYS = "window_id int, permno_a int, permno_b int"
FIT = ", ".join([f"scale_{leg}{k} double" for leg in "ab" for k in (0, 1)] + [f"{v}{c} double" for v in ("pa", "pb", "rho") for c in CELLS])


def volatility_regime(vix: DataFrame, rolling: int | None = None) -> DataFrame:
    """date, x: 0 where the level is at or above the median, of the last ``rolling`` days if given; else 1."""
    v = vix.select("date", F.col("vix").try_cast("double").alias("vix")).filter("vix IS NOT NULL")
    if rolling:
        w = Window.orderBy("date").rowsBetween(1 - rolling, Window.currentRow)  # a row for each day
        v = v.withColumn("ref", F.percentile("vix", 0.5).over(w))
    else:
        v = v.crossJoin(F.broadcast(v.agg(F.percentile("vix", 0.5).alias("ref"))))
    return v.select("date", F.when(F.col("vix") >= F.col("ref"), 0).otherwise(1).alias("x"))


def exogenous_contrast(stats: DataFrame, rows: DataFrame, regime: DataFrame, n_min: int = 10, width: int = 60) -> DataFrame:
    """Diagonal cells of valid pairs under the shared regime; pairs without a joint day are left out.

    Legs and the regime are bit masks of a window's days, so a pair is one row and its cells are bit counts. Windows are few (a row
    each), so their masks are broadcast.
    """
    pairs = valid_pairs(stats).select(*PAIR_KEYS, "regime")
    legs = day_masks(rows.filter("ret IS NOT NULL"), width, {"day": F.lit(True), "use": F.col("ret") != 0, "up": F.col("ret") > 0}, "window_id", "permno")
    days = rows.select("window_id", "t", "date").distinct().join(F.broadcast(regime), "date")
    shared = day_masks(days, width, {"z0": F.col("x") == 0, "z1": F.col("x") == 1}, "window_id")
    words = range(-(-width // WORD))
    for k in "ab":
        side = legs.select("window_id", F.col("permno").alias(f"permno_{k}"), *[F.col(f"{v}_{i}").alias(f"{v}{k}_{i}") for v in ("day", "use", "up") for i in words])
        pairs = pairs.join(side, ["window_id", f"permno_{k}"])
    pairs = pairs.join(F.broadcast(shared), "window_id", "left").fillna(0, [f"z{x}_{i}" for x in (0, 1) for i in words])
    add = lambda xs: reduce(lambda p, q: p + q, xs)
    out = []
    for x, c in ((0, "00"), (1, "11")):
        m = [F.col(f"usea_{i}").bitwiseAND(F.col(f"useb_{i}")).bitwiseAND(F.col(f"z{x}_{i}")) for i in words]
        n = add([F.bit_count(v) for v in m])
        ups = lambda k, m=m: add([F.bit_count(v.bitwiseAND(F.col(f"up{k}_{i}"))) for i, v in zip(words, m, strict=True)])
        differ = add([F.bit_count(v.bitwiseAND(F.col(f"upa_{i}").bitwiseXOR(F.col(f"upb_{i}")))) for i, v in zip(words, m, strict=True)])
        mean = lambda top, n=n: F.try_divide(top.cast("double"), n.cast("double"))
        out += [n.cast("long").alias(f"N{c}"), mean(n - 2 * differ).alias(f"E{c}"), mean(2 * ups("a") - n).alias(f"a{c}"), mean(2 * ups("b") - n).alias(f"b{c}")]
    joint = add([F.bit_count(F.col(f"daya_{i}").bitwiseAND(F.col(f"dayb_{i}"))) for i in words])
    g = pairs.filter(joint > 0).select(*PAIR_KEYS, "regime", *out)
    return g.select("*", (F.col("E00") - F.col("E11")).alias("dcmov"), ((F.col("N00") >= n_min) & (F.col("N11") >= n_min)).alias("valid_diag"))


def fit_pairs(a: np.ndarray, b: np.ndarray, n_min: int, q: float) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(jointly usable days, scales and cell probabilities) of each pair of rows."""
    joint = np.isfinite(a) & np.isfinite(b) & (a != 0) & (b != 0)
    n = joint.sum(axis=1)
    out, regime = {}, {}
    for leg, r in (("a", a), ("b", b)):
        m = np.abs(r)
        with np.errstate(invalid="ignore"):
            regime[leg] = (m < masked_quantile(m, joint, q)).astype(int)
        whole = masked_mean(m, joint)
        for k in (0, 1):
            mean = masked_mean(m, joint & (regime[leg] == k))
            out[f"scale_{leg}{k}"] = np.where(np.isfinite(mean), mean, whole)
    sa, sb = np.sign(a), np.sign(b)
    for c in CELLS:
        m = joint & (regime["a"] == int(c[0])) & (regime["b"] == int(c[1]))
        enough = m.sum(axis=1) >= 2
        pa, pb, e = masked_mean((sa + 1) / 2, m), masked_mean((sb + 1) / 2, m), masked_mean(sa * sb, m)
        ma, mb = 2 * pa - 1, 2 * pb - 1
        spread = (1 - ma * ma) * (1 - mb * mb)
        with np.errstate(invalid="ignore", divide="ignore"):
            rho = np.where(spread > 1e-12, np.clip((e - ma * mb) / np.sqrt(np.maximum(spread, 0.0)), -1, 1), 0.0)
        for name, value, empty in ((f"pa{c}", pa, 0.5), (f"pb{c}", pb, 0.5), (f"rho{c}", rho, 0.0)):
            out[name] = np.where(enough, value, empty)
    return n, out


def generator_fit(stats: DataFrame, rows: DataFrame, n_min: int = 10, q: float = 0.5) -> DataFrame:
    """Scales and cell probabilities of valid pairs with at least 4 * n_min jointly usable days.

    Thresholds are quantiles over those joint days. A cell of fewer than 2 days is fair and uncorrelated.
    """

    def kernel(pairs, a, b):
        n, fit = fit_pairs(a, b, n_min, q)
        yield pd.DataFrame({**{k: pairs[k] for k in PAIR_KEYS}, "n_days": n, **fit})[n >= 4 * n_min]

    return on_pairs(valid_pairs(stats).select(*PAIR_KEYS), rows, kernel, f"{_KEYS}, n_days long, {FIT}")

"""Sweep over threshold quantiles, and split-half reliability of the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS, pooled_weight, s_odd
from .pairs import cells_of_parts, day_masks, legs, legs_by_quantile, pair_cells, with_scores

# The swept quantiles and those where the relaxed floor applies.
QUANTILES = (0.25, 0.40, 0.42, 0.45, 0.48, 0.50, 0.75, 0.90, 0.95)
RELAXED_QUANTILES = (0.90, 0.95)


def relaxed_of(quantiles) -> tuple[float, ...]:
    return tuple(q for q in quantiles if q >= min(RELAXED_QUANTILES))


def sweep_pairs(rows: DataFrame, width: int, quantiles=QUANTILES, n_min: int = 3) -> DataFrame:
    """The pair table at every quantile, with theta_q: one aggregation to legs and one pair join for all of them."""
    return with_scores(pair_cells(legs_by_quantile(rows, width, quantiles), width, quantiles=quantiles), n_min)


def threshold_sweep(rows: DataFrame, labels: DataFrame, width: int = 60, quantiles=QUANTILES, n_min: int = 10, relaxed_n_min: int = 3, relaxed_quantiles=RELAXED_QUANTILES) -> DataFrame:
    """Strict and relaxed tallies for every quantile and regime that has pairs, valid or not."""
    pairs = sweep_pairs(rows, width, quantiles, min(n_min, relaxed_n_min)).join(F.broadcast(labels), "window_id", "left").withColumn("regime", F.coalesce("regime", F.lit("calm")))
    least = F.least(*[F.col(f"N{c}") for c in CELLS])
    strict, relaxed = least >= n_min, least >= relaxed_n_min
    g = pairs.groupBy("theta_q", "regime").agg(
        F.count_if(strict).alias("n_valid"),
        F.count_if(strict & (F.col("s_odd") > 2)).alias("k"),
        F.count_if(strict & (F.col("ctx") > 0)).alias("c"),
        F.count_if(relaxed).alias("n_valid_relaxed"),
        F.count_if(relaxed & (F.col("s_odd") > 2)).alias("kr"),
        F.count_if(relaxed & (F.col("ctx") > 0)).alias("cr"),
    )
    return g.select(
        "theta_q", "regime", F.lit(n_min).alias("n_min"), F.lit(relaxed_n_min).alias("relaxed_n_min"), "n_valid",
        F.try_divide("k", "n_valid").alias("naive_rate"), F.try_divide("c", "n_valid").alias("cbd_rate"),
        "n_valid_relaxed", F.try_divide("kr", "n_valid_relaxed").alias("naive_rate_relaxed"), F.try_divide("cr", "n_valid_relaxed").alias("cbd_rate_relaxed"),
        F.col("theta_q").isin([float(q) for q in relaxed_quantiles]).alias("is_relaxed_diag_q"),
    )


def split_half_weights(rows: DataFrame, width: int = 60, n_min: int = 10, q: float = 0.5, half_min_cell: int = 2) -> DataFrame:
    """window_id, pair, half and the three weights of pairs that are valid in the whole window and in both halves.

    Halves are the odd and even days among those with any return; thresholds are the whole window's. Windows with
    fewer than 8 such days or 3 members, or 3 valid pairs, or 3 common pairs, have no rows. Whole and halves are masks of the same
    legs: one aggregation and one pair join.
    """
    seen = rows.filter("ret IS NOT NULL")
    days = seen.select("window_id", "t").distinct()
    days = days.withColumn("odd", (F.row_number().over(Window.partitionBy("window_id").orderBy("t")) - 1) % 2)
    size = days.groupBy("window_id").agg(F.count(F.lit(1)).alias("d")).join(seen.groupBy("window_id").agg(F.countDistinct("permno").alias("m")), "window_id")
    good = size.filter("d >= 8 AND m >= 3").select("window_id")
    seen = seen.join(F.broadcast(good), "window_id", "left_semi")
    masks = day_masks(days, width, {"a": F.col("odd") == 0, "b": F.col("odd") == 1}, "window_id")
    pairs = cells_of_parts(legs(seen, width, q), masks, width, {"whole": None, "in_a": "a", "in_b": "b"})
    least = lambda part: F.least(*[F.col(f"{part}.N{c}") for c in CELLS])
    full = F.count(F.lit(1)).over(Window.partitionBy("window_id"))
    pairs = pairs.filter(least("whole") >= n_min).withColumn("full", full).filter(F.col("full") >= 3)
    pairs = pairs.filter((least("in_a") >= half_min_cell) & (least("in_b") >= half_min_cell)).withColumn("common", full).filter(F.col("common") >= 3)

    def weights(part: str, half: str):
        n = [F.col(f"{part}.N{c}") for c in CELLS]
        e = [F.try_divide(F.col(f"{part}._E{c}").cast("double"), k.cast("double")) for c, k in zip(CELLS, n, strict=True)]
        return F.struct(F.lit(half).alias("half"), s_odd(e).alias("w_s_odd"), e[0].alias("w_e00"), pooled_weight(e, n).alias("w_pooled"))

    return pairs.select("window_id", "permno_a", "permno_b", F.explode(F.array(weights("in_a", "a"), weights("in_b", "b"))).alias("h")).select("window_id", "permno_a", "permno_b", "h.*")


def guarded_corr(x: str, y: str, least: int = 3):
    """Pearson correlation from sums; null for fewer rows than least or where a side does not vary."""
    a, b = F.col(x), F.col(y)
    vx, vy = F.var_pop(a), F.var_pop(b)
    return F.when((F.count(F.lit(1)) >= least) & (vx > 1e-18) & (vy > 1e-18), F.try_divide(F.covar_pop(a, b), F.sqrt(vx * vy)))


def split_half_reliability(weights: DataFrame, windows: DataFrame) -> DataFrame:
    """Correlation of the two halves over a window's pairs, and its Spearman-Brown correction, for each weight."""
    keys = ["window_id", "permno_a", "permno_b"]
    a, b = (weights.filter(F.col("half") == h).select(*keys, *[F.col(f"w_{v}").alias(f"{v}_{h}") for v in ("s_odd", "e00", "pooled")]) for h in "ab")
    g = a.join(b, keys).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_pairs"), *[guarded_corr(f"{v}_a", f"{v}_b").alias(f"r_{v}") for v in ("s_odd", "e00", "pooled")])
    out = []
    for v, suffix in (("s_odd", ""), ("e00", "_e00"), ("pooled", "_pooled")):
        r = F.col(f"r_{v}")
        out += [r.alias(f"reliability_halfsplit{suffix}"), F.try_divide(2 * r, 1 + r).alias(f"reliability_sb{suffix}")]
    return g.join(F.broadcast(windows), "window_id").select("window_id", "win_start", "n_pairs", *out)

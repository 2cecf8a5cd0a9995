"""Who should count less or not at all: thinly traded members, and second share classes of one firm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS
from .pairs import day_masks, leg_masks, legs_by_window, with_regimes, with_scores, words
from .windows import indexed_calendar, with_windows

#: Binary digits of a leg-day's weight: 0 to 3.
DIGITS = 2


def trading_weights(volumes: DataFrame, bar: float, days: int = 20) -> DataFrame:
    """permno, date, weight, thin: thin where the volume (null: none) is under the bar; weight is 3 times the part of the member's
    last ``days`` rows, this one included, that are not thin, rounded down."""
    daily = volumes.groupBy("permno", "date").agg(F.sum("vol").alias("vol"))
    thin = F.coalesce(F.col("vol") < bar, F.lit(True))
    frame = Window.partitionBy("permno").orderBy("date").rowsBetween(1 - days, Window.currentRow)
    top = 2**DIGITS - 1
    weight = F.floor(top * F.sum(F.when(thin, 0).otherwise(1)).over(frame) / F.count(F.lit(1)).over(frame)).cast("int")
    return daily.select("permno", "date", weight.alias("weight"), thin.alias("thin"))


def weighted_legs(rows: DataFrame, weights: DataFrame, width: int = 60, q: float = 0.5, most_thin: float = 0.25) -> DataFrame:
    """Legs with one mask for each binary digit of the day's weight (w0_k, w1_k), and thin: over that part of its days is thin.

    Days without a weight count as thin, with weight 0.
    """
    d = with_regimes(rows, q).join(weights, ["permno", "date"], "left").fillna({"weight": 0, "thin": True})
    digits = {f"w{j}": F.col("weight").bitwiseAND(F.lit(1 << j)) != 0 for j in range(DIGITS)}
    extra = day_masks(d, width, digits, "window_id", "permno", more=[(F.avg(F.col("thin").cast("double")) > most_thin).alias("thin")])
    return leg_masks(d, width).join(extra, ["window_id", "permno"])


def _weighted(mask: Column, k: int) -> Column:
    """Sum of both legs' weights, multiplied, over the days of a mask: bit counts of the digits' masks."""
    parts = [(1 << (i + j)) * F.bit_count(mask.bitwiseAND(F.col(f"l.w{i}_{k}")).bitwiseAND(F.col(f"r.w{j}_{k}"))) for i in range(DIGITS) for j in range(DIGITS)]
    return reduce(lambda a, b: a + b, parts)


def weighted_pair_stats(rows: DataFrame, weights: DataFrame, width: int = 60, n_min: int = 10, q: float = 0.5, most_thin: float = 0.25) -> DataFrame:
    """Pairs with N (days), W (weights) and the weighted means E, a, b of the cells, scores, and thin_a, thin_b.

    A pair is valid if every cell has n_min days and some weight.
    """
    pairs = legs_by_window(weighted_legs(rows, weights, width, q, most_thin))
    add = lambda xs: reduce(lambda p, q: p + q, xs)
    cols = []
    for c in CELLS:
        n, w, a, b, e = [], [], [], [], []
        for k in words(width):
            m = F.col(f"l.g{c[0]}_{k}").bitwiseAND(F.col(f"r.g{c[1]}_{k}"))
            up, vp, all_ = F.col(f"l.up_{k}"), F.col(f"r.up_{k}"), _weighted(m, k)
            n.append(F.bit_count(m))
            w.append(all_)
            a.append(2 * _weighted(m.bitwiseAND(up), k) - all_)
            b.append(2 * _weighted(m.bitwiseAND(vp), k) - all_)
            e.append(all_ - 2 * _weighted(m.bitwiseAND(up.bitwiseXOR(vp)), k))
        cols += [add(n).cast("long").alias(f"N{c}"), add(w).cast("long").alias(f"W{c}")]
        cols += [add(v).cast("double").alias(f"_{name}{c}") for name, v in (("E", e), ("a", a), ("b", b))]
    pairs = pairs.select(F.col("l.window_id").alias("window_id"), F.col("l.permno").alias("permno_a"), F.col("r.permno").alias("permno_b"), *cols, F.col("l.thin").alias("thin_a"), F.col("r.thin").alias("thin_b"))
    means = [F.try_divide(F.col(f"_{v}{c}"), F.col(f"W{c}").cast("double")).alias(f"{v}{c}") for v in ("E", "a", "b") for c in CELLS]
    keys = ["window_id", "permno_a", "permno_b"]
    scored = with_scores(pairs.select(*keys, *[f"{v}{c}" for v in ("N", "W") for c in CELLS], *means, "thin_a", "thin_b"), n_min)
    weighed = F.least(*[F.col(f"W{c}") for c in CELLS]) > 0
    return scored.withColumns({c: F.when(weighed, F.col(c)) for c in ("s_odd", "delta", "ctx")} | {"valid": F.col("valid") & weighed})


def firm_of_members(eligibility: DataFrame, spells: DataFrame) -> DataFrame:
    """window_id, win_start, win_end, permno, firm: the company that the identifier had on the window's last day.

    spells: permno, permco, start, end (closed, null end: still open). Of overlapping spells the one that began last holds, then the
    lower company. A member without a spell has no company (null).
    """
    held = eligibility.join(spells, "permno", "left").withColumn("now", (F.col("win_end") >= F.col("start")) & (F.col("end").isNull() | (F.col("win_end") <= F.col("end"))))
    latest = F.max_by(F.when(F.col("now"), F.col("permco")), F.when(F.col("now"), F.struct("start", (-F.col("permco")).alias("low"))))
    return held.groupBy("window_id", "win_start", "win_end", "permno").agg(latest.alias("firm"))


def one_class_per_firm(eligibility: DataFrame, spells: DataFrame, volumes: DataFrame, calendar: DataFrame, width: int = 60, step: int = 21) -> DataFrame:
    """Eligibility with one member of each company and window: that of the largest volume within the window, then the lower number.

    Members without a company stay.
    """
    days = volumes.groupBy("permno", "date").agg(F.sum("vol").alias("vol")).join(F.broadcast(indexed_calendar(calendar)), "date")
    traded = with_windows(days, width, step).groupBy("window_id", "permno").agg(F.sum("vol").alias("traded"))
    firms = firm_of_members(eligibility, spells).join(traded, ["window_id", "permno"], "left")
    best = Window.partitionBy("window_id", "firm").orderBy(F.desc(F.coalesce("traded", F.lit(0))), "permno")
    ranked = firms.withColumn("place", F.row_number().over(best))
    return ranked.filter("firm IS NULL OR place = 1").select("window_id", "win_start", "win_end", "permno")

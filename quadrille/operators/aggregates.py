"""Summaries of the panel and of the pair table, and the data behind every figure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import CELLS, corrected, naive
from .pairs import valid_pairs
from .selection import bottom_k, exact_quantile

# Least edge, greatest edge and number of bins of each score.
BINS = {"s_odd": (0.0, 4.0, 80), "delta": (0.0, 2.0, 40), "ctx": (-4.0, 2.0, 120)}


def rates(df: DataFrame, *by: str) -> DataFrame:
    """n_pairs, naive_rate and cbd_rate of each group; a null score does not pass a bound."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(naive(F.col("s_odd"))).alias("naive_rate"), F.avg(corrected(F.col("ctx"))).alias("cbd_rate"))


def headline_rates(stats: DataFrame) -> DataFrame:
    ok = F.col("valid")
    g = stats.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(ok).alias("n_valid"),
        F.count_if(ok & (F.col("s_odd") > 2)).alias("n_naive"),
        F.count_if(ok & (F.col("ctx") > 0)).alias("n_cbd"),
    )
    return g.select("*", F.try_divide("n_naive", "n_valid").alias("naive_rate"), F.try_divide("n_cbd", "n_valid").alias("cbd_rate"))


def cell_summary(stats: DataFrame) -> DataFrame:
    return valid_pairs(stats).groupBy("regime").agg(F.count(F.lit(1)).alias("n_valid"), *[F.avg(f"N{c}").alias(f"N{c}") for c in CELLS])


def edges_of(spec: tuple[float, float, int]) -> list[float]:
    return [float(x) for x in np.linspace(spec[0], spec[1], spec[2] + 1)]


def _bin(col, edges: list[float]):
    """Bin of a value by the edges themselves: left-closed, the last one closed at both ends; null outside.

    A guess by arithmetic is put right against the neighbouring edges, so it agrees with a search in them.
    """
    n, lo, hi = len(edges) - 1, edges[0], edges[-1]
    array = F.array(*map(F.lit, edges))

    def let(value, f):  # names a value, so that its expression is not repeated in the plan
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def place(v):
        guess = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) / n)).cast("int")))
        right = lambda g: F.when((g < n - 1) & (v >= F.get(array, g + 1)), g + 1).when(v < F.get(array, g), g - 1).otherwise(g)
        return F.when((v >= lo) & (v <= hi), let(guess, right))

    return let(col, place)


def histogram(df: DataFrame, var: str, edges: list[float], *by: str) -> DataFrame:
    """Counts in fixed bins for each group that has rows, empty bins included; values outside are dropped."""
    counts = df.select(*by, _bin(F.col(var), edges).alias("bin")).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    spark, n = df.sparkSession, len(edges) - 1
    array = F.array(*map(F.lit, edges))
    grid = spark.range(n).select(F.col("id").cast("int").alias("bin"), F.get(array, F.col("id").cast("int")).alias("bin_left"), F.get(array, F.col("id").cast("int") + 1).alias("bin_right"))
    if by:
        grid = df.select(*by).distinct().crossJoin(F.broadcast(grid))  # the grid has a row for each bin
    out = grid.join(counts, [*by, "bin"], "left")
    return out.select(F.lit(var).alias("var"), *by, "bin_left", "bin_right", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def stat_histograms(stats: DataFrame) -> DataFrame:
    ok = valid_pairs(stats)
    out = None
    for var, spec in BINS.items():
        h = histogram(ok, var, edges_of(spec), "regime")
        out = h if out is None else out.unionByName(h)
    return out


def density(hist: DataFrame, *by: str) -> DataFrame:
    """Bin centres and densities of a histogram."""
    total = F.sum("count").over(Window.partitionBy("var", *by))
    width = F.col("bin_right") - F.col("bin_left")
    return hist.select("var", *by, ((F.col("bin_left") + F.col("bin_right")) / 2).alias("center"), F.try_divide(F.col("count"), total * width).alias("density"))


def pair_sectors(stats: DataFrame, sectors: DataFrame, prefix: str = "within:") -> DataFrame:
    s = sectors.select("permno", "sector")
    a, b = (s.select(F.col("permno").alias(f"permno_{k}"), F.col("sector").alias(f"_{k}")) for k in "ab")
    df = stats.join(a, "permno_a", "left").join(b, "permno_b", "left")
    return df.withColumn("pair_sector", F.when(F.col("_a") == F.col("_b"), F.concat(F.lit(prefix), "_a")).otherwise("cross")).drop("_a", "_b")


def sector_rates(stats: DataFrame, sectors: DataFrame) -> DataFrame:
    return rates(pair_sectors(valid_pairs(stats), sectors), "regime", "pair_sector")


def sector_rates_sorted(stats: DataFrame, sectors: DataFrame) -> DataFrame:
    return rates(pair_sectors(valid_pairs(stats), sectors, ""), "pair_sector").orderBy(F.desc("naive_rate"), "pair_sector")


def coverage_by_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(F.col("ret").isNotNull(), 1.0).otherwise(0.0)).alias("availability"), F.avg(F.when(F.col("ret") == 0, 1.0).otherwise(0.0)).alias("zero_rate"))


def threshold_band(theta: DataFrame) -> DataFrame:
    q = F.percentile("theta", [0.1, 0.5, 0.9])
    return theta.groupBy("window_id").agg(q.alias("q")).select("window_id", F.get("q", F.lit(0)).alias("q10"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q90"))


def box_stats(df: DataFrame, value, *by: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the number of values."""
    rows = df.select(*by, value.alias("v")).filter("v IS NOT NULL")
    q = rows.groupBy(*by).agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select(*by, "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ok = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(q, list(by)).groupBy(*by, "n", "q1", "median", "q3").agg(F.min(F.when(ok, F.col("v"))).alias("low"), F.max(F.when(ok, F.col("v"))).alias("high"))


def absolute_return_boxes(panel: DataFrame, freq: str = "month") -> DataFrame:
    p = panel.withColumn("period", F.date_trunc(freq, "date").cast("date"))
    return box_stats(p, F.abs("ret") * 100, "period")


def cell_count_boxes(stats: DataFrame) -> DataFrame:
    """Box statistics of the four cell counts by regime."""
    pairs = valid_pairs(stats).select("regime", F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"N{c}").cast("double").alias("k")) for c in CELLS])).alias("s")).select("regime", "s.cell", "s.k")
    return box_stats(pairs, F.col("k"), "regime", "cell")


def return_histogram(panel: DataFrame, bins: int = 80, trim: float = 0.999) -> DataFrame:
    """Equal-width histogram of |ret| below its trimming quantile, with the trimmed median as threshold."""
    r = panel.filter("ret IS NOT NULL").select(F.abs("ret").alias("v"))
    kept = r.filter(F.col("v") < exact_quantile(r, F.col("v"), trim)) if trim < 1 and not r.isEmpty() else r
    theta = F.lit(exact_quantile(kept, F.col("v"), 0.5)).cast("double")
    span = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("theta", theta)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0))).cast("int")
    return kept.crossJoin(F.broadcast(span)).withColumn("bin", b).groupBy("bin", "theta").agg(F.count(F.lit(1)).alias("count"))


def equal_weight_index(panel: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Compounded mean return, and the index level if given, both rebased to 1 at their first day."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each day
    daily = panel.groupBy("date").agg(F.avg("ret").alias("r"))
    growth = F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(w))
    out = daily.withColumn("g", growth).select("date", (F.col("g") / F.first("g").over(w)).alias("equal_weight"))
    if levels is not None:
        index = levels.select("date", (F.col("spindx") / F.first("spindx").over(w)).alias("index_level"))
        out = out.join(index, "date", "left")
    return out


def regime_table(stats: DataFrame) -> DataFrame:
    return stats.groupBy("window_id").agg(F.min("win_start").alias("win_start"), F.min("regime").alias("regime"))


def crisis_runs(windows: DataFrame) -> DataFrame:
    """Runs of consecutive windows with regime crisis: first and last window and the span of their starts."""
    w = Window.orderBy("window_id")  # a row for each window
    r = windows.withColumn("all", F.row_number().over(w)).filter("regime = 'crisis'")
    r = r.withColumn("run", F.col("all") - F.row_number().over(w))
    return r.groupBy("run").agg(F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"), F.min("win_start").alias("start"), F.max("win_start").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")


def eligible_over_time(eligibility: DataFrame, labels: DataFrame) -> DataFrame:
    n = eligibility.groupBy("window_id", "win_start").agg(F.countDistinct("permno").alias("n_eligible"))
    return n.join(F.broadcast(labels), "window_id", "left")


# Samples: rows of least hash, so they do not depend on the order of rows or the number of tasks.


def _hash(*keys: str, seed: int = 0):
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


PAIR_KEYS = ("window_id", "permno_a", "permno_b")


def sample_pairs(stats: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n valid pairs without replacement."""
    return valid_pairs(stats).withColumn("_h", _hash(*PAIR_KEYS, seed=seed)).orderBy("_h", *PAIR_KEYS).limit(n).drop("_h")


def scatter_quota(stats: DataFrame, cap: int = 20_000, seed: int = 0) -> DataFrame:
    """An even share of the cap from each window's valid pairs, at least one each."""
    ok = valid_pairs(stats)
    n = ok.select("window_id").distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(cap) / F.count(F.lit(1)))).alias("quota"))
    w = Window.partitionBy("window_id").orderBy(_hash(*PAIR_KEYS, seed=seed), "permno_a", "permno_b")
    return ok.withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(n)).filter("rank <= quota").select(*PAIR_KEYS, "s_odd", "delta", "ctx", "regime")


def group_sample(df: DataFrame, cap: int, by: list[str], keys: tuple[str, ...] = PAIR_KEYS, seed: int = 0) -> DataFrame:
    """At most cap rows of each group, each subset as likely as any other."""
    return bottom_k(df, cap, by, _hash(*by, *keys, seed=seed), *keys)


def violation_rates(stats: DataFrame) -> DataFrame:
    """Rates by regime, crisis first, then calm, then others."""
    order = F.when(F.col("regime") == "crisis", 0).when(F.col("regime") == "calm", 1).otherwise(2)
    return rates(valid_pairs(stats), "regime").orderBy(order, "regime")


def range_histogram(df: DataFrame, var: str, bins: int, *by: str) -> DataFrame:
    """Counts in equal-width bins over the range of all values, bins with rows only; the last bin is closed."""
    v = df.filter(F.col(var).isNotNull()).select(*by, F.col(var).alias("v"))
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))).cast("int")
    return v.crossJoin(F.broadcast(span)).groupBy(*by, b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count")).withColumn("var", F.lit(var))


def score_distributions(stats: DataFrame, bins: int = 50) -> DataFrame:
    """Histograms of the three scores by regime over their own ranges."""
    ok = valid_pairs(stats)
    return range_histogram(ok, "s_odd", bins, "regime").unionByName(range_histogram(ok, "delta", bins, "regime")).unionByName(range_histogram(ok, "ctx", bins, "regime"))


def summed_histogram(hist: DataFrame, var: str) -> DataFrame:
    """A score's fixed-edge histogram over all regimes."""
    return hist.filter(F.col("var") == var).groupBy("bin_left", "bin_right").agg(F.sum("count").alias("count"))


def null_overlay(stats: DataFrame, null: DataFrame, bins: int = 59, least: float = -2.0, most: float = 1.0) -> DataFrame:
    """Densities of ctx of real and simulated valid pairs in the same bins, over the real ones' range (least to most at least)."""
    real = valid_pairs(stats).filter("ctx IS NOT NULL").select(F.lit("empirical").alias("source"), F.col("ctx").alias("v"))
    both = real.unionByName(valid_pairs(null).filter("ctx IS NOT NULL").select(F.lit("classical_null").alias("source"), F.col("ctx").alias("v")))
    span = real.agg(F.least(F.min("v"), F.lit(least)).alias("lo"), F.greatest(F.max("v"), F.lit(most)).alias("hi"))  # one row
    inside = both.crossJoin(F.broadcast(span)).filter("v BETWEEN lo AND hi")
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))).cast("int")
    counts = inside.groupBy("source", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.groupBy("source").agg(F.sum("count").alias("n"))  # two rows
    density = F.col("count") / (F.col("n") * ((F.col("hi") - F.col("lo")) / bins))
    return counts.join(F.broadcast(whole), "source").select("source", "bin", "lo", "hi", "count", density.alias("density"))


def coupling_amount(stats: DataFrame, bound: float = 2.0) -> DataFrame:
    """Mean share of a window's possible pairs at or above the absolute bound, by regime."""
    ok = valid_pairs(stats)
    ends = ok.select("window_id", F.explode(F.array("permno_a", "permno_b")).alias("p")).groupBy("window_id").agg(F.countDistinct("p").alias("n"))
    hits = ok.groupBy("window_id", "regime").agg(F.count_if(F.col("s_odd") >= bound).alias("m"))
    share = F.coalesce(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return hits.join(ends, "window_id").groupBy("regime").agg(F.avg(share).alias("edge_density"), F.count(F.lit(1)).alias("n_windows"))

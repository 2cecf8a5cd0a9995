"""Scores of all pairs of members in all windows.

A leg (window, member) is reduced to day bitmasks: large and small usable days, and positive ones. Cells of a pair
are bit counts of ANDs, so the pair join makes one row for each pair, not for each day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.scores import CELLS

WORD = 60
#: Members of a tile: a task of the pair join makes the pairs of two tiles, whatever the window's size.
TILE = 256


def thresholds(rows: DataFrame, q: float = 0.5) -> DataFrame:
    """window_id, permno, theta: interpolated quantile of |ret| over all days with a return, zero ones included."""
    return rows.filter("ret IS NOT NULL").groupBy("window_id", "permno").agg(F.percentile(F.abs("ret"), q).alias("theta"))


def with_regimes(rows: DataFrame, q: float = 0.5, theta: DataFrame | None = None) -> DataFrame:
    """Usable days (return present and not zero) with their threshold and regime: 0 large, 1 small.

    Without given thresholds, they come from the same window of the plan as the days: one shuffle.
    """
    if theta is None:
        w = Window.partitionBy("window_id", "permno")
        rows = rows.filter("ret IS NOT NULL").withColumn("theta", F.percentile(F.abs("ret"), q).over(w))
    else:
        rows = rows.filter("ret IS NOT NULL").join(theta, ["window_id", "permno"])
    return rows.withColumn("x", F.when(F.abs("ret") >= F.col("theta"), 0).otherwise(1))


def words(width: int) -> range:
    return range(-(-width // WORD))


def legs(rows: DataFrame, width: int = 60, q: float = 0.5, theta: DataFrame | None = None, days: Column | None = None) -> DataFrame:
    """window_id, permno and masks g0_k, g1_k, up_k in words of 60 days. days restricts what counts.

    Every member with a return in the window has a leg, if only an empty one.
    """
    return leg_masks(with_regimes(rows, q, theta), width, days)


def leg_masks(d: DataFrame, width: int = 60, days: Column | None = None) -> DataFrame:
    """Legs from days that have a regime x, wherever that comes from."""
    usable = (F.col("ret") != 0) & (days if days is not None else F.lit(True))
    aggs = []
    for k in words(width):
        bit = F.when(usable & (F.floor(F.col("t") / WORD) == k), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t") - k * WORD).cast("int")))
        for name, cond in ((f"g0_{k}", F.col("x") == 0), (f"g1_{k}", F.col("x") == 1), (f"up_{k}", F.col("ret") > 0)):
            aggs.append(F.coalesce(F.sum(F.when(cond, bit)), F.lit(0)).alias(name))
    return d.groupBy("window_id", "permno").agg(*aggs)


def _cells(width: int, suffix: str = "", days: str | None = None) -> dict[str, Column]:
    """Counts and sums of the four cells from the masks of legs l and r; suffix tells the masks of one of several thresholds.

    days names masks that restrict what counts.
    """
    out = {}
    for c in CELLS:
        n, sa, sb, sab = [], [], [], []
        for k in words(width):
            m = F.col(f"l.g{c[0]}_{k}{suffix}").bitwiseAND(F.col(f"r.g{c[1]}_{k}{suffix}"))
            m = m.bitwiseAND(F.col(f"{days}_{k}")) if days else m
            up, vp = F.col(f"l.up_{k}"), F.col(f"r.up_{k}")
            count = F.bit_count(m)
            n.append(count)
            sa.append(2 * F.bit_count(m.bitwiseAND(up)) - count)
            sb.append(2 * F.bit_count(m.bitwiseAND(vp)) - count)
            sab.append(count - 2 * F.bit_count(m.bitwiseAND(up.bitwiseXOR(vp))))
        add = lambda xs: reduce(lambda p, q: p + q, xs)
        out |= {f"N{c}": add(n).cast("long"), f"_a{c}": add(sa), f"_b{c}": add(sb), f"_E{c}": add(sab)}
    return out


def legs_by_quantile(rows: DataFrame, width: int, quantiles) -> DataFrame:
    """Legs with the masks of every quantile's threshold (g0_k_qi, g1_k_qi) and one set of signs; all from one shuffle."""
    w = Window.partitionBy("window_id", "permno")
    d = rows.filter("ret IS NOT NULL").withColumn("theta", F.percentile(F.abs("ret"), list(map(float, quantiles))).over(w))
    aggs = []
    for k in words(width):
        bit = F.when((F.col("ret") != 0) & (F.floor(F.col("t") / WORD) == k), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t") - k * WORD).cast("int")))
        flags = {f"up_{k}": F.col("ret") > 0}
        for i in range(len(quantiles)):
            large = F.abs("ret") >= F.get("theta", F.lit(i))
            flags |= {f"g0_{k}_q{i}": large, f"g1_{k}_q{i}": ~large}
        aggs += [F.coalesce(F.sum(F.when(cond, bit)), F.lit(0)).alias(name) for name, cond in flags.items()]
    return d.groupBy("window_id", "permno").agg(*aggs)


def legs_by_window(legs: DataFrame) -> DataFrame:
    """All unordered pairs of a window's legs, as l and r with l.permno < r.permno.

    A window's members are cut, in order, into tiles of TILE, as many as their measured number needs. Tiles i <= j meet in a task of
    their own: a leg goes there once for each tile of its window, and no task makes more than TILE * TILE pairs of one key, however many
    members a window has.
    """
    window = Window.partitionBy("window_id")
    place, tiles = F.row_number().over(window.orderBy("permno")) - 1, F.ceil(F.count(F.lit(1)).over(window) / TILE)
    dealt = legs.withColumn("tile", F.floor(place / TILE).cast("int")).withColumn("tiles", tiles.cast("int"))
    l = dealt.withColumn("other", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).alias("l")
    r = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tile")))).alias("r")
    met = (F.col("l.window_id") == F.col("r.window_id")) & (F.col("l.tile") == F.col("r.other")) & (F.col("l.other") == F.col("r.tile"))
    return l.join(r, met & (F.col("l.permno") < F.col("r.permno")))


def pair_cells(left: DataFrame, width: int = 60, quantiles=()) -> DataFrame:
    """All unordered pairs of legs in each window with N, E, a and b of the cells; pairs without joint days included.

    With quantiles (of legs_by_quantile), each pair has a row for each, made behind the one join.
    """
    pairs = legs_by_window(left)
    names = [F.col("l.window_id").alias("window_id"), F.col("l.permno").alias("permno_a"), F.col("r.permno").alias("permno_b")]
    if not quantiles:
        return _means(pairs.select(*names, *[v.alias(k) for k, v in _cells(width).items()]))
    each = [F.struct(F.lit(float(q)).alias("theta_q"), *[v.alias(k) for k, v in _cells(width, f"_q{i}").items()]) for i, q in enumerate(quantiles)]
    return _means(pairs.select(*names, F.explode(F.array(*each)).alias("q")).select("window_id", "permno_a", "permno_b", "q.*"), "theta_q")


def _means(pairs: DataFrame, *more: str) -> DataFrame:
    means = [F.try_divide(F.col(f"_{v}{c}").cast("double"), F.col(f"N{c}").cast("double")).alias(f"{v}{c}") for v in ("E", "a", "b") for c in CELLS]
    return pairs.select("window_id", "permno_a", "permno_b", *more, *means, *[f"N{c}" for c in CELLS])


def day_masks(days: DataFrame, width: int, flags: dict[str, Column], *by: str, more=()) -> DataFrame:
    """Bit masks, in words of WORD days, of the days (t) on which each flag holds; with more aggregates, if given."""
    aggs = []
    for k in words(width):
        bit = F.when(F.floor(F.col("t") / WORD) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t") - k * WORD).cast("int")))
        aggs += [F.coalesce(F.sum(F.when(cond, bit)), F.lit(0)).alias(f"{name}_{k}") for name, cond in flags.items()]
    return days.groupBy(*by).agg(*aggs, *more)


def cells_of_parts(left: DataFrame, masks: DataFrame, width: int, parts: dict[str, str | None]) -> DataFrame:
    """All pairs with a struct of cells for each part: those of the days in a mask of the window, or all (None). One pair join.

    masks has a row for each window, so it is broadcast.
    """
    pairs = legs_by_window(left).join(F.broadcast(masks.withColumnRenamed("window_id", "w")), F.col("l.window_id") == F.col("w"))
    structs = [F.struct(*[v.alias(k) for k, v in _cells(width, days=days).items()]).alias(part) for part, days in parts.items()]
    return pairs.select(F.col("l.window_id").alias("window_id"), F.col("l.permno").alias("permno_a"), F.col("r.permno").alias("permno_b"), *structs)


def with_scores(pairs: DataFrame, n_min: int = 10) -> DataFrame:
    """Adds s_odd, delta, ctx and valid; scores of pairs that are not valid are null."""
    e, a, b = ([F.col(f"{v}{c}") for c in CELLS] for v in ("E", "a", "b"))
    ok = F.least(*[F.col(f"N{c}") for c in CELLS]) >= n_min
    s, d = scores.s_odd(e), scores.delta(a, b)
    pairs = pairs.withColumn("valid", ok).withColumn("s_odd", F.when(ok, s)).withColumn("delta", F.when(ok, d))
    return pairs.withColumn("ctx", scores.ctx(F.col("s_odd"), F.col("delta")))


def pair_window_stats(rows: DataFrame, windows: DataFrame, width: int = 60, n_min: int = 10, q: float = 0.5, labels: DataFrame | None = None, theta: DataFrame | None = None, days: Column | None = None) -> DataFrame:
    """The pair table: bounds, cells, scores, valid and regime (``calm`` where no label is given)."""
    out = with_scores(pair_cells(legs(rows, width, q, theta, days), width), n_min)
    out = out.join(F.broadcast(windows), "window_id")
    if labels is None:
        out = out.withColumn("regime", F.lit("calm"))
    else:
        out = out.join(F.broadcast(labels.select("window_id", "regime")), "window_id", "left").withColumn("regime", F.coalesce("regime", F.lit("calm")))
    cells = [f"{v}{c}" for v in ("E", "a", "b", "N") for c in CELLS]
    return out.select("window_id", "win_start", "win_end", "permno_a", "permno_b", *cells, "s_odd", "delta", "ctx", "valid", "regime")


def valid_pairs(stats: DataFrame) -> DataFrame:
    return stats.filter("valid") if "valid" in stats.columns else stats

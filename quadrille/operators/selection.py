"""Exact order statistics by selection: counts of cells narrow down where a rank lies, and only the rows of the last cell are sorted.

No task holds or sorts all values. Counts are partially aggregated and have at most ``CELLS`` rows a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a pass, and rows that one task may sort at the end.
CELLS, LAST = 65_536, 200_000


def bottom_k(df: DataFrame, k: int, by: list[str], digest: Column, *ties: str) -> DataFrame:
    """The k rows of least digest in each group; ties by the given columns. digest is a hexadecimal hash, evenly spread.

    The first four digits of the digest are cells. The cell in which a group reaches k rows is known from counts; rows in cells beyond
    it go before anything is shuffled or sorted, which leaves k and a 65,536th of the group.
    """
    cell = F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    rows = df.withColumn("_digest", digest).withColumn("_cell", cell)
    counts = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell"))
    needed = counts.withColumn("_before", up_to - F.col("_n")).filter(F.col("_before") < k)
    last = needed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.max("_cell").alias("_last"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    rows = rows.join(last, same).filter("_cell <= _last")
    least = Window.partitionBy(*by).orderBy("_digest", *ties)
    return rows.withColumn("_place", F.row_number().over(least)).filter(F.col("_place") <= k).select(df.columns)


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    at = q * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _at_rank(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of a rank (from 0) among values v from low to high."""
    while True:
        inside = values.filter(F.col("v").between(low, high))
        if high > low:
            cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v") - low) / (high - low) * CELLS)).cast("int")
        else:
            return low
        counts = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("n").over(Window.orderBy("cell")) - F.col("n")  # CELLS rows at most
        c = counts.withColumn("before", before).filter((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank)).first()
        rank, low, high = rank - c["before"], c["least"], c["most"]
        if low < high and c["n"] <= LAST:
            last = values.filter(F.col("v").between(low, high)).withColumn("place", F.row_number().over(Window.orderBy("v")))  # LAST rows at most
            return last.filter(F.col("place") == rank + 1).first()["v"]


def exact_quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """Interpolated quantile of all values that are not null, as ``percentile`` gives it; None without any.

    Every pass reads the table and sends one row to the driver; values that are equal end it at once, however many they are.
    """
    values = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    s = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not s["n"]:
        return None
    low, high, part = _ranks(s["n"], q)
    a = _at_rank(values, low, s["low"], s["high"])
    if part == 0:
        return a
    b = _at_rank(values, high, s["low"], s["high"])
    return a if a == b else (1 - part) * a + part * b

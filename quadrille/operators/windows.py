"""Rolling windows of a fixed number of calendar rows, and who is present throughout them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(panel: DataFrame) -> DataFrame:
    return panel.select("date").filter("date IS NOT NULL").distinct()


def indexed_calendar(calendar: DataFrame) -> DataFrame:
    """date, i, n: place from 0 and number of dates. A calendar is small by nature, so one partition sorts it."""
    w = Window.orderBy("date")
    return calendar.select("date", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def with_windows(days: DataFrame, width: int, step: int) -> DataFrame:
    """Rows with i and n, once for each full window they lie in: window_id and t, the place in the window."""
    last = F.floor((F.col("n") - width) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / step))
    high = F.least(F.floor(F.col("i") / step), last)
    rows = days.filter((F.col("n") >= width) & (low <= high))
    rows = rows.withColumn("window_id", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return rows.withColumn("t", F.col("i") - F.col("window_id") * step)


def hopping_windows(calendar: DataFrame, width: int = 60, step: int = 21) -> DataFrame:
    """window_id, win_start, win_end of all windows of full length."""
    rows = with_windows(indexed_calendar(calendar), width, step)
    return rows.groupBy("window_id").agg(F.min("date").alias("win_start"), F.max("date").alias("win_end"))


def window_eligibility(membership: DataFrame, calendar: DataFrame, width: int = 60, step: int = 21, frac: float = 1.0) -> DataFrame:
    """window_id, win_start, win_end, permno where spells cover at least the given part of the window's days.

    The calendar is broadcast: it has a row for each trading day there is. Overlapping spells count once.
    """
    days = indexed_calendar(calendar)
    covered = membership.join(F.broadcast(days), F.col("date").between(F.col("mbrstartdt"), F.col("mbrenddt"))).select("permno", "date", "i", "n").distinct()
    counts = with_windows(covered, width, step).groupBy("window_id", "permno").agg(F.count(F.lit(1)).alias("days"))
    ok = counts.filter(F.col("days") / width >= frac).select("window_id", "permno")
    return ok.join(F.broadcast(hopping_windows(calendar, width, step)), "window_id").select("window_id", "win_start", "win_end", "permno")


def first_windows(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n lowest window ids."""
    ids = df.select("window_id").distinct().orderBy("window_id").limit(n)
    return df.join(F.broadcast(ids), "window_id", "left_semi")


def window_panel(panel: DataFrame, eligibility: DataFrame, calendar: DataFrame, width: int = 60, step: int = 21) -> DataFrame:
    """window_id, permno, date, t, ret of eligible members' days; repeated days are averaged first.

    An equi-join through the calendar's index in place of a range join on dates.
    """
    daily = panel.groupBy("permno", "date").agg(F.avg("ret").alias("ret"))
    days = daily.join(F.broadcast(indexed_calendar(calendar)), "date")
    rows = with_windows(days, width, step)
    return rows.join(eligibility.select("window_id", "permno"), ["window_id", "permno"]).select("window_id", "permno", "date", "t", "ret")


def eligible_per_window(eligibility: DataFrame) -> DataFrame:
    return eligibility.groupBy("window_id").agg(F.countDistinct("permno").alias("n_eligible"))


def eligible_summary(eligibility: DataFrame) -> DataFrame:
    """Least, median and largest number of members, and the pairs at the median."""
    s = eligible_per_window(eligibility).agg(F.min("n_eligible").alias("n_min"), F.percentile("n_eligible", 0.5).alias("n_median"), F.max("n_eligible").alias("n_max"))
    med = F.floor("n_median").cast("long")
    return s.withColumn("pairs_at_median", F.floor(med * (med - 1) / 2).cast("long"))

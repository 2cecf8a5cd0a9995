"""Regimes that do not come from the window's own returns: lagged volatility, and days around scheduled events.

Both give masks that are sorted by something known beforehand, to be compared with the regimes of the same day's moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import leg_masks, pair_cells, with_scores
from .windows import indexed_calendar


def lagged_volatility(panel: DataFrame, days: int = 20, least: int = 10) -> DataFrame:
    """permno, date, vol: root mean square of the member's last ``days`` returns before the date; null for fewer than ``least``.

    Days without a return take no place in that frame, and repeated days are averaged first. The frame reaches back as far as the panel
    does, so the first days of a window have a volatility as well.
    """
    daily = panel.filter("ret IS NOT NULL").groupBy("permno", "date").agg(F.avg("ret").alias("ret"))
    before = Window.partitionBy("permno").orderBy("date").rowsBetween(-days, -1)
    vol = F.when(F.count("ret").over(before) >= least, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(before)))
    return daily.select("permno", "date", vol.alias("vol"))


def with_lagged_regimes(rows: DataFrame, volatility: DataFrame, q: float = 0.5) -> DataFrame:
    """Days that have a return and a lagged volatility, with their regime: 0 where it reaches its own quantile within the window, else 1."""
    leg = Window.partitionBy("window_id", "permno")
    known = rows.filter("ret IS NOT NULL").join(volatility.filter("vol IS NOT NULL"), ["permno", "date"])
    known = known.withColumn("theta", F.percentile("vol", q).over(leg))
    return known.withColumn("x", F.when(F.col("vol") >= F.col("theta"), 0).otherwise(1))


def lagged_pair_stats(rows: DataFrame, panel: DataFrame, width: int = 60, n_min: int = 10, q: float = 0.5, days: int = 20, least: int = 10) -> DataFrame:
    """The pair table's cells and scores with each leg's days sorted by its lagged volatility."""
    legs = leg_masks(with_lagged_regimes(rows, lagged_volatility(panel, days, least), q), width)
    return with_scores(pair_cells(legs, width), n_min)


def rolled_events(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """date, n_events: events (a row with a date each) on the day itself, or on the next calendar day if there was no trading.

    Events after the last calendar day have no day yet and are left out. Events are counted by date first, so both sides that
    meet have a row for each day at most; one partition sorts them, as it does the calendar.
    """
    by_day = events.filter("date IS NOT NULL").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    both = by_day.select("date", "n", F.lit(None).cast("date").alias("open")).union(calendar.select("date", F.lit(0).cast("long"), F.col("date")))
    ahead = Window.orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rolled = both.withColumn("day", F.min("open").over(ahead)).filter("n > 0 AND day IS NOT NULL")
    return rolled.groupBy(F.col("day").alias("date")).agg(F.sum("n").alias("n_events"))


def event_regime(calendar: DataFrame, events: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """date, x of every calendar day: 0 within so many calendar days before and after a rolled event, else 1."""
    days = indexed_calendar(calendar)
    hit = days.join(F.broadcast(rolled_events(events, calendar)), "date")  # a row for each day at most
    near = hit.select(F.explode(F.sequence(F.col("i") - before, F.col("i") + after)).alias("i")).distinct().withColumn("hit", F.lit(True))
    return days.join(F.broadcast(near), "i", "left").select("date", F.when(F.col("hit"), 0).otherwise(1).alias("x"))

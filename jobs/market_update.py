"""Scores the pairs of every window that has closed since the last run.

    python -m jobs.market_update --input DIR --output DIR [--config FILE]

Reads ``lineitem`` and ``part``: weekly revenue of each brand, its change against the week before, rolling windows of closed weeks, and
the scores of all pairs of brands that are present throughout a window. A week is closed once there is a later one. Writes

* ``pairs``, by window_id: the pair table;
* ``windows``, by run (the first window of the run that wrote it): bounds, regime, members, pairs and how many violate each bound;
* ``mark``: the next window to score and its first week.

A run reads the facts from a week before that first week on, no earlier ones. The mark is written last: a run that failed is run
again from the same window and writes the same partitions over. A run without a newly closed window writes nothing. Facts that arrive for
weeks of scored windows change nothing; to score them again, take a new output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille import schemas
from quadrille.operators import labels, pairs, windows
from quadrille.session import discard, prepare, stored
from quadrille.sources import testdata

from . import common
from .common import log

MARK = "next_window int, next_week date"
SUMMARY = "window_id int, win_start date, win_end date, regime string, n_members long, n_pairs long, n_valid long, n_naive long, n_cbd long, run int"


def weekly_changes(weekly: DataFrame) -> DataFrame:
    """permno, date, ret of the closed weeks; ret is null where a brand has no revenue in the week before."""
    last = weekly.agg(F.max("date").alias("last"))
    before = Window.partitionBy("permno").orderBy("date")
    change = F.when(F.lag("date").over(before) == F.date_sub("date", 7), F.try_divide(F.col("rev"), F.lag("rev").over(before)) - 1)
    return weekly.select("permno", "date", change.alias("ret")).join(F.broadcast(last), F.col("date") < F.col("last")).drop("last")


def window_rows(panel: DataFrame, calendar: DataFrame, width: int, step: int, least_presence: float) -> DataFrame:
    """window_id, permno, date, t, ret of members with a row on at least that part of the window's weeks."""
    rows = windows.with_windows(panel.join(F.broadcast(windows.indexed_calendar(calendar)), "date"), width, step)
    weeks = F.count(F.lit(1)).over(Window.partitionBy("window_id", "permno"))
    return rows.withColumn("weeks", weeks).filter(F.col("weeks") / width >= least_presence).select("window_id", "permno", "date", "t", "ret")


def summary(stats: DataFrame, run: int) -> DataFrame:
    ends = F.explode(F.array("permno_a", "permno_b"))
    members = stats.select("window_id", ends.alias("m")).groupBy("window_id").agg(F.countDistinct("m").alias("n_members"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    out = stats.groupBy("window_id", "win_start", "win_end", "regime").agg(F.count(F.lit(1)).alias("n_pairs"), n(F.col("valid"), "n_valid"), n(F.col("s_odd") > 2, "n_naive"), n(F.col("ctx") > 0, "n_cbd"))
    return out.join(members, "window_id").withColumn("run", F.lit(run)).select(*[c.split()[0] for c in SUMMARY.split(", ")])


def read_pairs(spark: SparkSession, out: str) -> DataFrame:
    return common.read_or_empty(spark, f"{out}/pairs", schemas.PAIRS)


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    return common.read_or_empty(spark, f"{out}/windows", SUMMARY)


def run(spark: SparkSession, tables_dir: str, out: str, config: dict) -> dict:
    """One run; returns what it read and wrote."""
    prepare(spark)
    width, step = config["width"], config["step"]
    if not 0 < step < width:
        raise ValueError("step must be from 1 to width - 1: the next window has to begin in a week that is known")
    mark = common.last_mark(spark, f"{out}/mark", MARK, "next_window")
    first, since = (mark["next_window"], mark["next_week"]) if mark else (0, None)
    items = spark.read.parquet(f"{tables_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice")
    if since:
        items = items.filter(F.col("l_shipdate") >= F.date_sub(F.lit(since), 7).cast(items.schema["l_shipdate"].dataType))
    items, seen = common.counted(items, "facts")
    weekly = stored(testdata.weekly_revenue(items, spark.read.parquet(f"{tables_dir}/part.parquet")), "weekly")
    log.info("read %d facts from %s on", common.rows_of(seen), since or "the first week")
    panel = weekly_changes(weekly)
    panel = stored(panel.filter(F.col("date") >= F.lit(since)) if since else panel, "changes")
    calendar = stored(windows.trading_calendar(panel), "weeks")
    bounds = windows.hopping_windows(calendar, width, step)
    done = {"facts": common.rows_of(seen), "first_window": first, "windows": bounds.count(), "pairs": 0}
    if done["windows"]:
        rows = window_rows(panel, calendar, width, step, config["least_presence"])
        stats = pairs.pair_window_stats(rows, bounds, width, config["n_min"], config["theta_quantile"], labels.label_windows(bounds, config["regimes"] or None))
        done["pairs"] = common.overwrite_partitions(stats.withColumn("window_id", F.col("window_id") + first), f"{out}/pairs", "window_id")
        new = read_pairs(spark, out).filter(F.col("window_id") >= first)
        common.overwrite_partitions(summary(new, first), f"{out}/windows", "run")
        after = windows.indexed_calendar(calendar).filter(F.col("i") == done["windows"] * step).first()
        common.add_mark(spark, f"{out}/mark", MARK, (first + done["windows"], after["date"]))
    log.info("scored %d windows from %d on, wrote %d pairs to %s/pairs", done["windows"], first, done["pairs"], out)
    discard(weekly, panel, calendar)
    return done


if __name__ == "__main__":
    common.main("market_update", run, "Scores the pairs of every window that has closed since the last run.")

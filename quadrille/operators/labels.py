"""Labels of windows from spans, a volatility series, or named episodes. Spans are closed at both ends."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import SPANS, TAXONOMY, available
from ..sources.tables import read_file

# Recessions as (start, end).
RECESSIONS = [("1990-07-01", "1991-03-31"), ("2001-03-01", "2001-11-30"), ("2007-12-01", "2009-06-30"), ("2020-02-01", "2020-04-30")]
# Named episodes as (name, start, end, type, notes).
EPISODES = [
    ("Gulf War oil shock", "1990-08-01", "1991-02-28", "energy/financial", None),
    ("Asian crisis / LTCM", "1997-07-01", "1998-12-31", "financial", None),
    ("Dot-com bust", "2000-03-01", "2002-10-31", "financial", None),
    ("Global food price crisis", "2007-01-01", "2008-08-31", "food", None),
    ("Global Financial Crisis", "2007-12-01", "2009-06-30", "financial", None),
    ("Russian wheat ban / Arab Spring food spike", "2010-06-01", "2011-12-31", "food", None),
    ("European sovereign debt", "2011-05-01", "2012-09-30", "financial", None),
    ("Oil / commodity collapse", "2014-06-01", "2016-02-29", "energy/commodity", None),
    ("COVID-19", "2020-02-01", "2020-06-30", "mixed/financial", None),
    ("Russia-Ukraine food-energy", "2022-02-01", "2022-12-31", "food/energy", None),
]
BUILT_IN = ("nber", "nber:builtin")
AGGREGATES = {"mean": F.avg, "median": F.median, "max": F.max}


def recessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(date.fromisoformat(a), date.fromisoformat(b)) for a, b in RECESSIONS], SPANS)


def taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Named episodes, of a CSV file if given, with their place in the list; none, with the same types, if the file is missing."""
    if path:
        try:
            rows = spark.read.option("header", True).option("quote", '"').schema(TAXONOMY).csv(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], TAXONOMY)
        return rows.withColumn("place", F.monotonically_increasing_id())
    rows = [(n, date.fromisoformat(a), date.fromisoformat(b), t, x, k) for k, (n, a, b, t, x) in enumerate(EPISODES)]
    return spark.createDataFrame(rows, f"{TAXONOMY}, place long")


def _overlaps() -> Column:
    return (F.col("win_start") <= F.col("end")) & (F.col("win_end") >= F.col("start"))


def label_by_spans(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """window_id, regime: crisis if the window overlaps a span. Span lists are short, so they are broadcast."""
    hit = windows.join(F.broadcast(spans), _overlaps(), "left_semi").select("window_id").withColumn("hit", F.lit(1))
    return windows.select("window_id").join(hit, "window_id", "left").select("window_id", F.when(F.col("hit") == 1, "crisis").otherwise("calm").alias("regime"))


def volatility_by_window(windows: DataFrame, vix: DataFrame, how: str = "mean") -> DataFrame:
    joined = windows.join(F.broadcast(vix), F.col("date").between(F.col("win_start"), F.col("win_end")), "left")
    return joined.groupBy("window_id").agg(AGGREGATES[how]("vix").alias("level"))


def label_by_volatility(windows: DataFrame, vix: DataFrame, how: str = "mean", threshold: float | None = None, q: float = 0.5) -> DataFrame:
    """window_id, regime: crisis if the aggregate is above the threshold, or above the q-quantile of all windows'."""
    v = vix.select("date", F.col("vix").try_cast("double").alias("vix"))
    levels = volatility_by_window(windows, v, how)
    if threshold is None:
        levels = levels.crossJoin(F.broadcast(levels.agg(F.percentile("level", q).alias("bar"))))
    else:
        levels = levels.withColumn("bar", F.lit(float(threshold)))
    return levels.select("window_id", F.when(F.col("level") > F.col("bar"), "crisis").otherwise("calm").alias("regime"))


def label_windows(windows: DataFrame, source: DataFrame | str | None = None, threshold: float | None = None, q: float = 0.5, how: str = "mean") -> DataFrame:
    """By nothing (all calm), by built-in recessions (``nber`` in any case), or by a table with date and vix, or start and end.

    A table may be given by the path of its file. Windows are calm if there is no such file, or it has other columns.
    """
    if isinstance(source, str):
        if source.lower() in BUILT_IN:
            return label_by_spans(windows, recessions(windows.sparkSession))
        try:
            source = read_file(windows.sparkSession, source)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if isinstance(source, DataFrame):
        if len(cols := available(source, "date", "vix")) == 2:
            return label_by_volatility(windows, source.select(F.col(cols[0]).cast("date").alias("date"), F.col(cols[1]).alias("vix")), how, threshold, q)
        if len(cols := available(source, "start", "end")) == 2:
            return label_by_spans(windows, source.select(F.col(cols[0]).cast("date").alias("start"), F.col(cols[1]).cast("date").alias("end")))
    return windows.select("window_id", F.lit("calm").alias("regime"))


def tag_windows(windows: DataFrame, episodes: DataFrame) -> DataFrame:
    """window_id, crisis_names (in the list's order) and crisis_types (sorted) of overlapping episodes, or ``none``."""
    hits = windows.select("window_id", "win_start", "win_end").join(F.broadcast(episodes), _overlaps(), "left")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("place", "name")))), lambda s: s["name"])
    got = hits.groupBy("window_id").agg(names.alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("type", "/"))))).alias("t"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ";")).otherwise("none")
    return got.select("window_id", joined("n").alias("crisis_names"), joined("t").alias("crisis_types"))

"""The panel and the member counts over a stream of priced events.

The reference computation is a batch one; this is the same aggregation for events that keep arriving, with late events
allowed up to a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def streaming_totals(events: DataFrame, time_col: str = "ts", key_col: str = "user_id", value_col: str = "value", every: str = "7 days", late: str = "14 days") -> DataFrame:
    """key, period start and total of each period; works on a batch or a stream. Times are cast, as watermarks need timestamps with zone."""
    e = events.select(F.col(key_col).alias("key"), F.col(time_col).cast("timestamp").alias("ts"), F.col(value_col).cast("double").alias("value"))
    e = e.withWatermark("ts", late)
    g = e.groupBy("key", F.window("ts", every).alias("w")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("w.start").cast("date").alias("period"), "total", "n")


def finished_totals(spark: SparkSession, path: str, store: str, **options) -> DataFrame:
    """Runs the totals over the events that are there now, as a stream, and returns those of periods that the watermark has closed."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file will do as well as a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
    run = streaming_totals(events, **options).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
    run.start(f"{store}/totals").awaitTermination()
    return spark.read.schema("key long, period date, total double, n long").parquet(f"{store}/totals")


def returns_from_totals(totals: DataFrame) -> DataFrame:
    """permno, date, ret from finished periods (a batch table that a stream has written)."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("period")
    return totals.select(F.col("key").cast("int").alias("permno"), F.col("period").alias("date"), (F.try_divide(F.col("total"), F.lag("total").over(w)) - 1).alias("ret"))

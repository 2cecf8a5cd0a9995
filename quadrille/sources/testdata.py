"""A panel of weekly brand returns, and what goes with it, from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _week(c: str):
    return F.date_trunc("week", F.col(c)).cast("date")


def weekly_revenue(items: DataFrame, parts: DataFrame) -> DataFrame:
    """permno (a brand's number), date (week), rev; sums are in whole cents, so they do not depend on the order."""
    items = items.select("l_partkey", _week("l_shipdate").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    items = items.groupBy("l_partkey", "date").agg(F.sum("cents").alias("cents"))
    brands = parts.select("p_partkey", F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int").alias("permno"))
    joined = items.join(brands, items.l_partkey == brands.p_partkey)
    return joined.groupBy("permno", "date").agg((F.sum("cents") / 100.0).alias("rev"))


def brand_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_revenue(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno, date, ret: change of revenue against the brand's week before; null for its first."""
    w = Window.partitionBy("permno").orderBy("date")
    return brand_revenue(spark, sf_dir).select("permno", "date", (F.try_divide(F.col("rev"), F.lag("rev").over(w)) - 1).alias("ret"))


def membership(panel: DataFrame) -> DataFrame:
    """Spells: the whole span, cut at its start or end for some brands; some have a second, overlapping spell."""
    span = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    base = panel.select("permno").distinct().crossJoin(F.broadcast(span))
    start = F.when(F.col("permno") % 7 == 0, F.date_add("lo", 420)).otherwise(F.col("lo"))
    end = F.when(F.col("permno") % 5 == 0, F.date_sub("hi", 420)).otherwise(F.col("hi"))
    first = base.select("permno", start.alias("mbrstartdt"), end.alias("mbrenddt"))
    second = base.filter(F.col("permno") % 11 == 0).select("permno", F.date_add("lo", 140).alias("mbrstartdt"), F.col("hi").alias("mbrenddt"))
    return first.unionByName(second)


def volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (week), vix: mean order price, from whole cents."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_week("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.groupBy("date").agg((F.sum("cents") / F.count(F.lit(1)) / 1000000.0).alias("vix"))


def sectors(panel: DataFrame) -> DataFrame:
    return panel.select("permno").distinct().withColumn("sector", F.concat(F.lit("S"), F.floor(F.col("permno") / 10).cast("string")))


def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, spindx: revenue of all brands."""
    return brand_revenue(spark, sf_dir).groupBy("date").agg((F.sum(F.round(F.col("rev") * 100).cast("long")) / 100.0).alias("spindx"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """permno (brand), date (week), vol: units sold."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", _week("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("vol"))
    items = items.groupBy("l_partkey", "date").agg(F.sum("vol").alias("vol"))
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int").alias("permno"))
    return items.join(brands, items.l_partkey == brands.p_partkey).groupBy("permno", "date").agg(F.sum("vol").alias("vol"))


def identifier_spells(panel: DataFrame) -> DataFrame:
    """permno, permco, start, end: three brands to a company; every fourth one goes over to the next, with spells that overlap."""
    span = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    base = panel.select("permno").distinct().crossJoin(F.broadcast(span)).withColumn("permco", F.floor(F.col("permno") / 3).cast("int"))
    first = base.filter("permno % 10 <> 0").select("permno", "permco", F.col("lo").alias("start"), F.when(F.col("permno") % 4 == 0, F.date_add("lo", 900)).alias("end"))
    second = base.filter("permno % 10 <> 0 AND permno % 4 = 0").select("permno", F.col("permco") + 1, F.date_add("lo", 800), "hi")
    return first.union(second)


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, name: first and last day of each month on which there were orders; many are no first day of a week, when the panel trades."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"))
    months = days.groupBy(F.date_trunc("month", "day").alias("month")).agg(F.min("day").alias("opening"), F.max("day").alias("closing"))
    return months.select(F.explode(F.array(*(F.struct(F.col(c).alias("date"), F.lit(c).alias("name")) for c in ("opening", "closing")))).alias("e")).select("e.*")

"""Windows scored by state over a stream, and tables listed from footers."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import pairs, windows
from quadrille.sources import footers, tables
from quadrille.streaming import legs
from tests.test_engine import START, make_panel


def day(k):
    return START + dt.timedelta(k)


def write(spark, rows, path):
    spark.createDataFrame(rows, "permno int, date date, ret double").coalesce(1).write.mode("append").parquet(path)


def batch(spark, panel, calendar, elig, width, step):
    """The pair table of all rows at once."""
    rows = windows.window_panel(panel, elig, calendar, width, step)
    return pairs.with_scores(pairs.pair_cells(pairs.legs(rows, width, 0.6), width), 1)


def as_rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("width, step", [(20, 7), (70, 30)])
def test_stream_equals_batch(spark, tmp_path, width, step):
    """Files out of order, days up to ten days late, a member that ends early, days off the calendar; in two runs over growing input."""
    rng = random.Random(width)
    panel = make_panel(spark, 5, 150, 3, gaps=True).filter("permno < 5 OR date < '2020-03-01'")
    data = [tuple(r) for r in panel.collect()] + [(1, day(3), 0.5), (None, day(4), 0.1), (2, None, 0.1)]
    off = {day(k) for k in range(150) if k % 11 == 4}
    calendar = spark.createDataFrame([(day(k),) for k in range(150) if day(k) not in off], "date date")
    memb = spark.createDataFrame([(p, day(0), day(149)) for p in range(1, 6)], "permno int, mbrstartdt date, mbrenddt date")
    elig = windows.window_eligibility(memb, calendar, width, step)
    parts = [[] for _ in range(6)]
    for r in data:  # a file holds 25 days, and some of the last ones come with the next file
        k = 0 if r[1] is None else (r[1] - START).days
        late = k % 25 >= 20 and rng.random() < 0.3
        parts[min(5, k // 25 + late)].append(r)
    out = None
    for n in (3, 6):
        for part in parts[n - 3 : n]:
            rng.shuffle(part)
            write(spark, part, f"{tmp_path}/returns.parquet")
        out = legs.finished_pairs(spark, f"{tmp_path}/returns.parquet", f"{tmp_path}/store", calendar, elig, width, step, 1, 0.6, "12 days", 1)
    closed = [r["window_id"] for r in windows.hopping_windows(calendar, width, step).filter(F.date_add("win_end", 1) <= F.lit(day(149 - 12))).collect()]
    whole = batch(spark, spark.createDataFrame(data, "permno int, date date, ret double"), calendar, elig, width, step)
    assert len(closed) > 1 and as_rows(out.select(whole.columns)) == as_rows(whole.filter(F.col("window_id").isin(closed)))
    assert out.filter("valid").count() > 0


def test_days_later_than_the_watermark_are_dropped(spark, tmp_path):
    path, calendar = f"{tmp_path}/returns.parquet", spark.createDataFrame([(day(k),) for k in range(60)], "date date")
    elig = spark.createDataFrame([(w, p) for w in range(5) for p in (1, 2)], "window_id int, permno int")
    rng = np.random.default_rng(1)
    rows = [(p, day(k), float(rng.normal())) for p in (1, 2) for k in range(60)]
    write(spark, [r for r in rows if r[1] != day(5)], path)
    run = lambda: legs.finished_pairs(spark, path, f"{tmp_path}/store", calendar, elig, 20, 10, 0, 0.5, "3 days", 1)
    first = as_rows(run())
    write(spark, [r for r in rows if r[1] == day(5)], path)
    assert first and as_rows(run()) == first


def test_leg_masks_equal_those_of_a_batch(spark):
    rng = np.random.default_rng(5)
    for width, days in ((60, 41), (130, 100)):
        t = np.sort(rng.choice(width, days, replace=False))
        ret = np.where(rng.random(days) < 0.2, 0.0, rng.normal(size=days))
        df = spark.createDataFrame([(3, 7, int(a), float(b)) for a, b in zip(t, ret, strict=True)], "window_id int, permno int, t int, ret double")
        want = pairs.legs(df, width, 0.37).first().asDict()
        names = [c.split()[0] for c in legs.leg_schema(width).split(", ")]
        assert dict(zip(names, legs.leg_row(3, 7, t, ret, width, 0.37), strict=True)) == want


def test_footers(spark, tmp_path, monkeypatch):
    """Single files and folders, partitions, dates and times, nulls, no rows; against the same footers read by another engine."""
    monkeypatch.setattr(footers, "FILES", 2)
    d = spark.range(100).select("id", F.date_add(F.lit("2001-05-01"), F.col("id").cast("int")).alias("day"), (F.col("id") % 3).alias("p"))
    d.repartition(4).write.parquet(f"{tmp_path}/many.parquet")
    d.write.partitionBy("p").parquet(f"{tmp_path}/parts.parquet")
    d.limit(0).coalesce(1).write.parquet(f"{tmp_path}/empty.parquet")
    d.select("id", F.when(F.col("id") < 0, F.col("day")).alias("day"), F.lit(dt.datetime(2020, 1, 2, 3, 4, 5)).alias("at")).coalesce(1).write.parquet(f"{tmp_path}/nulls.parquet")
    d.write.csv(f"{tmp_path}/other.csv")
    duckdb.execute(f"COPY (SELECT range AS k, DATE '1999-01-01' + CAST(range AS INT) AS day FROM range(5)) TO '{tmp_path}/one.parquet'")
    got = {r["name"]: r for r in tables.list_tables(spark, str(tmp_path)).collect()}
    assert list(got) == ["empty", "many", "nulls", "one", "parts"]
    for name in got:
        files = f"'{tmp_path}/{name}.parquet'" if name == "one" else f"'{tmp_path}/{name}.parquet/**/*.parquet'"
        rows = duckdb.sql(f"SELECT sum(num_rows) FROM parquet_file_metadata({files})").fetchall()[0][0]
        size = duckdb.sql(f"SELECT sum(size) FROM read_blob({files})").fetchall()[0][0]
        assert (got[name]["n_rows"], got[name]["bytes"]) == (rows, size)
    assert {n: r["n_cols"] for n, r in got.items()} == {"empty": 3, "many": 3, "nulls": 3, "one": 2, "parts": 2}
    spans = {(r["name"], r["column"]): (r["first_time"], r["last_time"]) for r in footers.table_spans(spark, str(tmp_path)).collect()}
    time = lambda *x: dt.datetime(*x)
    assert spans[("many", "day")] == spans[("parts", "day")] == (time(2001, 5, 1), time(2001, 8, 8)) and spans[("one", "day")] == (time(1999, 1, 1), time(1999, 1, 5))
    assert ("nulls", "day") not in spans and not any(n == "empty" for n, _ in spans)
    assert tables.list_tables(spark, f"{tmp_path}/other.csv").count() == 0

"""The jobs by two runs over growing input, by runs that failed in between, and against SQL."""

import datetime as dt
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, market_update, queries, source_volumes

SF = "/root/testdata/sf0.001"
CONFIG = common.settings("market_update") | {"width": 30, "step": 12, "n_min": 2, "least_presence": 0.5}
VOLUMES = common.settings("source_volumes") | {"block": 20, "width": 4, "step": 1, "n_min": 1, "files_per_batch": 1}


def rows(df):
    return sorted(map(str, queries.rounded(df.select(sorted(df.columns))).collect()))


def market_folder(spark, path, until=None):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    (items.filter(F.col("l_shipdate") < F.lit(until)) if until else items).write.mode("overwrite").parquet(f"{path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.mode("overwrite").parquet(f"{path}/part.parquet")
    return str(path)


def files_of(spark, path):
    return {r["f"] for r in spark.read.parquet(path).select(F.concat("_metadata.file_path", F.lit("@"), F.col("_metadata.file_modification_time").cast("string")).alias("f")).distinct().collect()}


def test_market_takes_only_what_is_new(spark, tmp_path):
    whole, out, once = market_folder(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "once")
    total = market_update.run(spark, whole, once, CONFIG)
    market_folder(spark, whole, dt.date(1998, 3, 4))
    first = market_update.run(spark, whole, out, CONFIG)
    before = files_of(spark, f"{out}/pairs")
    assert 0 < first["windows"] < total["windows"] and first["facts"] < total["facts"] and first["first_window"] == 0
    # a second run over the same tables writes nothing
    again = market_update.run(spark, whole, out, CONFIG)
    assert again["windows"] == again["pairs"] == 0 and files_of(spark, f"{out}/pairs") == before
    market_folder(spark, whole)
    second = market_update.run(spark, whole, out, CONFIG)
    assert second["first_window"] == first["windows"] and first["windows"] + second["windows"] == total["windows"]
    assert second["facts"] < total["facts"] and before < files_of(spark, f"{out}/pairs")  # old windows are as they were
    assert rows(market_update.read_pairs(spark, out)) == rows(market_update.read_pairs(spark, once))
    assert rows(market_update.read_windows(spark, out).drop("run")) == rows(market_update.read_windows(spark, once).drop("run"))


def test_market_after_a_failure(spark, tmp_path, monkeypatch):
    """The pairs are written, the mark is not: the next run writes the same windows again."""
    out, once = str(tmp_path / "out"), str(tmp_path / "once")
    market_update.run(spark, SF, once, CONFIG)

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(common, "add_mark", fail)
    with pytest.raises(RuntimeError):
        market_update.run(spark, SF, out, CONFIG)
    monkeypatch.undo()
    assert market_update.run(spark, SF, out, CONFIG)["windows"] > 0
    assert rows(market_update.read_pairs(spark, out)) == rows(market_update.read_pairs(spark, once))
    assert rows(market_update.read_windows(spark, out)) == rows(market_update.read_windows(spark, once))


def test_market_gaps_and_empty_tables(spark, tmp_path):
    """A change needs revenue in the week before; the latest week is open; no facts, no output."""
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(7 * k)
    weekly = spark.createDataFrame([(1, day(k), float(k + 1)) for k in (0, 1, 3, 4, 5)] + [(2, day(4), 0.0), (2, day(5), 7.0)], "permno int, date date, rev double")
    got = {(r["permno"], r["date"]): r["ret"] for r in market_update.weekly_changes(weekly).collect()}
    assert got == {(1, day(0)): None, (1, day(1)): 1.0, (1, day(3)): None, (1, day(4)): 0.25, (2, day(4)): None}
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/in/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{tmp_path}/in/part.parquet")
    assert market_update.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG) == {"facts": 0, "first_window": 0, "windows": 0, "pairs": 0}
    assert market_update.read_pairs(spark, f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError):
        market_update.run(spark, SF, f"{tmp_path}/other", CONFIG | {"step": 30})


def documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(None, "no id", "en", "src1"), (5, None, "en", None), (6, "", None, None)], d.schema)
    return d.union(more)


def test_source_volumes_over_growing_input(spark, tmp_path):
    """New files only; late documents change the windows that hold them, and no others."""
    docs, path = documents(spark), f"{tmp_path}/in/documents.parquet"
    late = F.col("doc_id").isin(80, 81, 82, 83)
    parts = [docs.filter((F.col("doc_id") < 120) & ~late), docs.filter("doc_id >= 120"), docs.filter(late | F.col("doc_id").isNull())]
    docs.write.parquet(f"{tmp_path}/all/documents.parquet")
    source_volumes.run(spark, f"{tmp_path}/all", f"{tmp_path}/once", VOLUMES)
    out, taken, files = f"{tmp_path}/out", [], []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        taken.append(source_volumes.run(spark, f"{tmp_path}/in", out, VOLUMES)["documents"])
        files.append(files_of(spark, f"{out}/pairs"))
    assert taken == [p.count() for p in parts]
    kept = lambda a, b: {f.split("window_id=")[1].split("/")[0] for f in files[a] & files[b]}
    assert kept(0, 1) == {"0", "1"} and kept(1, 2) == {"0"}  # late documents are in block 4, which window 1 holds
    assert source_volumes.run(spark, f"{tmp_path}/in", out, VOLUMES) == {"documents": 0, "pairs": 0} and files_of(spark, f"{out}/pairs") == files[2]
    assert rows(source_volumes.read_pairs(spark, out)) == rows(source_volumes.read_pairs(spark, f"{tmp_path}/once"))
    assert source_volumes.read_pairs(spark, out).filter("source_b = 'unknown' OR source_a = 'unknown'").count() == 0


def test_source_volumes_after_a_failure(spark, tmp_path, monkeypatch):
    """The stream has taken the documents, the scores are missing."""
    monkeypatch.setattr(source_volumes, "score", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        source_volumes.run(spark, SF, f"{tmp_path}/out", VOLUMES)
    monkeypatch.undo()
    assert source_volumes.run(spark, SF, f"{tmp_path}/out", VOLUMES)["documents"] == 0
    source_volumes.run(spark, SF, f"{tmp_path}/once", VOLUMES)
    got = source_volumes.read_pairs(spark, f"{tmp_path}/out")
    assert rows(got) == rows(source_volumes.read_pairs(spark, f"{tmp_path}/once")) and got.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: "-" if v is None or v != v else f"{v:.7f}" if isinstance(v, float) else str(v)[:10]
    cols = sorted(got.columns)
    assert sorted([text(v) for v in r] for r in got.select(cols).toPandas().itertuples(index=False)) == sorted([text(v) for v in r] for r in want[cols].itertuples(index=False))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_line(tmp_path):
    config = tmp_path / "own.toml"
    config.write_text("width = 4\nstep = 2\n")
    run = [sys.executable, "-m", "jobs.source_volumes", "--input", SF, "--output", str(tmp_path / "out"), "--config", str(config)]
    for said in ("wrote ", "nothing new"):
        got = subprocess.run(run, capture_output=True, text=True, cwd=common.Path(common.__file__).parent.parent, timeout=240)
        assert got.returncode == 0 and said in got.stderr

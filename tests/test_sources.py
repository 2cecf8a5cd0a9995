from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quadrille import cli, schemas
from quadrille.sources import tables, testdata
from quadrille.streaming import panel


def test_round_trip_of_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2020, 1, 2), float("nan")), (2, date(2020, 1, 3), 0.5)], schemas.RETURNS)
    tables.save_table(df, str(tmp_path), "daily_returns", subdir=None)
    tables.save_table(df.limit(1), str(tmp_path), "daily_returns", kind="csv")
    assert tables.read_table(spark, str(tmp_path), "daily_returns").count() == 2
    assert tables.read_table(spark, str(tmp_path), "daily_returns", processed_first=True).count() == 1
    assert tables.read_optional(spark, str(tmp_path), "nothing") is None
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "nothing")
    assert tables.conform(df, schemas.RETURNS).filter("ret IS NULL").count() == 1
    assert tables.describe(df).first().asDict() == {"n_rows": 2, "first_date": date(2020, 1, 2), "last_date": date(2020, 1, 3), "n_cols": 3}
    assert tables.export_csv(df, str(tmp_path / "x"), sheet_rows=1, cap=1) == 1
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 1


def test_queries_for_databases():
    assert tables.return_column(["PERMNO", "DlyRet"]) == "dlyret" and tables.return_column([]) == "ret" and tables.return_column(["ret", "dlyret"]) == "ret"
    preds = tables.returns_predicates(list(range(900)), "2000-01-01", "2001-01-01")
    assert len(preds) == 3 and preds[0].count(",") == 399
    assert "mbrenddt >= '2000-01-01'" in tables.membership_query("s.t", "2000-01-01", "2001-01-01")
    assert tables.human_bytes(1536) == "1.5 KB"


def test_returns_are_cleaned(spark):
    df = spark.createDataFrame([(1, "2020-01-02", "0.1", "-5"), (1, "2020-01-03", "C", "4")], "PERMNO int, date string, DlyRet string, PRC string")
    assert [tuple(r) for r in tables.clean_returns(df).collect()] == [(1, date(2020, 1, 2), 0.1, 5.0), (1, date(2020, 1, 3), None, 4.0)]
    names = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "permno int, TICKER string")
    assert tables.identifiers(names, df).count() == 1


def test_names_of_other_installations(spark):
    df = spark.createDataFrame([(2, "2020-01-03", 0.5, -7.0, 9, 3), (1, "2020-01-02", float("nan"), 4.0, 8, 2)], "permno long, DLYCALDT string, ret double, DlyPrc double, dlyvol int, dlyshrout int")
    got = tables.clean_returns(df)
    assert got.columns == ["permno", "date", "ret", "prc", "vol", "shrout"]
    assert [tuple(r) for r in got.collect()] == [(1, date(2020, 1, 2), None, 4.0, 8.0, 2.0), (2, date(2020, 1, 3), 0.5, 7.0, 9.0, 3.0)]


def test_tables_that_parquet_cannot_hold_are_saved_as_csv(spark, tmp_path):
    path = tables.save_table(spark.sql("SELECT 1 AS a, make_interval(1, 2, 3) AS b"), str(tmp_path), "odd", None)
    assert path.endswith("odd.csv") and spark.read.csv(path, header=True).first()["a"] == "1"


def test_listing(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "seven.parquet"))
    r = tables.list_tables(spark, str(tmp_path)).collect()
    assert [(x["name"], x["n_rows"], x["n_cols"]) for x in r] == [("seven", 7, 1)] and r[0]["bytes"] > 0 and r[0]["size"].endswith("KB")
    sizes = [0, 1023, 1024, 1536, 1024**2, 5 * 1024**3, 3 * 1024**4]
    texts = spark.createDataFrame([(n,) for n in sizes], "n long").select(tables.human_bytes_column(F.col("n"))).collect()
    assert [t[0] for t in texts] == [tables.human_bytes(n) for n in sizes]


def test_extraction_from_a_database(spark, tmp_path):
    """The whole extraction against an embedded database, reached by JDBC."""
    url = "jdbc:derby:memory:market;create=true"
    days = [date(2000, 1, 3) + timedelta(d) for d in range(200)]
    put = lambda df, name: df.toDF(*map(str.upper, df.columns)).write.jdbc(url, name, "overwrite")
    put(spark.createDataFrame([(1, days[0], days[-1]), (2, days[50], days[-1]), (3, date(1980, 1, 1), date(1980, 5, 1))], "permno int, mbrstartdt date, mbrenddt date"), "members")
    put(spark.createDataFrame([(p, d, 0.01 * p, -1.0 * p) for p in (1, 2, 3) for d in days], "permno int, dlycaldt date, dlyret double, dlyprc double"), "daily")
    put(spark.createDataFrame([(1, "A", "x"), (3, "C", "y")], "permno int, ticker string, other string"), "names")
    assert tables.table_columns(spark, url, "daily") == {"permno", "dlycaldt", "dlyret", "dlyprc"} and tables.table_columns(spark, url, "nowhere") == set()
    args = ["extract", "--data-dir", str(tmp_path), "--url", url, "--start", "2000-01-01", "--end", "2000-12-31", "--members-table", "members", "--returns-table", "daily", "--names-table", "names", "--step-days", "60"]
    a = cli.parser().parse_args(args)
    cli.STAGES[a.stage](spark, a)
    ret = tables.read_table(spark, str(tmp_path), "daily_returns")
    assert ret.count() == 400 and ret.columns == ["permno", "date", "ret", "prc"] and ret.filter("prc < 0 OR permno = 3").count() == 0
    assert tables.read_table(spark, str(tmp_path), "identifiers").collect()[0].asDict() == {"permno": 1, "ticker": "A"}
    elig = tables.read_table(spark, str(tmp_path), "window_eligibility")
    assert {(r["window_id"], r["permno"]) for r in elig.collect()} == {(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)}
    assert tables.read_returns(spark, url, "daily", [], "2000-01-01", "2000-12-31").count() == 0
    assert tables.read_returns(spark, url, "daily", [1, 2], "2000-01-03", "2000-01-04").count() == 4


def test_stream_and_batch_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = panel.streaming_totals(stream, late="4000 days").writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["key"], r["period"], round(r["total"], 6), r["n"]) for r in df.collect())
    assert key(spark.table("totals")) == key(panel.streaming_totals(events))
    assert panel.returns_from_totals(spark.table("totals")).columns == ["permno", "date", "ret"]


def test_command_line(spark, tmp_path):
    d = str(tmp_path)
    ret = testdata.returns(spark, "/root/testdata/sf0.001").persist()
    tables.save_table(ret, d, "daily_returns", subdir=None)
    tables.save_table(ret.select("date").distinct(), d, "trading_calendar", subdir=None)
    tables.save_table(testdata.membership(ret), d, "membership", subdir=None)
    for args in (["rebuild", "--window-days", "60", "--step-days", "120"], ["analyze", "--n-min", "2", "--null", "--step-days", "120", "--null-max-pairs", "50"], ["networks", "--mrqap-nperm", "3", "--gate-nodes", "0"], ["sweep", "--quantiles", "0.5,0.9", "--n-min", "2", "--step-days", "120"], ["view", "headline_rates"], ["list"]):
        a = cli.parser().parse_args([*args, "--data-dir", d])
        cli.STAGES[a.stage](spark, a)
    assert tables.read_table(spark, d, "network_metrics").count() > 0
    assert 0 < tables.read_table(spark, d, "classical_null_stats").count() <= 50
    assert tables.read_table(spark, d, "classical_null_hist").count() == 120
    assert {r["theta_q"] for r in tables.read_table(spark, d, "threshold_sweep").collect()} == {0.5, 0.9}
    for args in (["networks", "--no-mrqap", "--stats-file", f"{d}/processed/pair_window_stats.parquet", "--out", f"{d}/plain"], ["networks", "--mrqap-nperm", "3", "--gate-nodes", "0", "--partialled", "--null-stats-file", f"{d}/processed/classical_null_stats.parquet", "--out", f"{d}/gate"], ["figures", "--max-points", "30"], ["csv", "headline_rates", "--force", "--out", f"{d}/rates"]):
        a = cli.parser().parse_args([*args, "--data-dir", d])
        cli.STAGES[a.stage](spark, a)
    assert tables.read_optional(spark, f"{d}/plain", "network_qap") is None and tables.read_table(spark, f"{d}/plain", "network_metrics").count() > 0
    assert tables.read_table(spark, f"{d}/gate", "network_gate_summary").count() == 1 and "predictor" in tables.read_table(spark, f"{d}/gate", "network_qap_partialled").columns
    figures = {r["name"] for r in tables.list_tables(spark, f"{d}/figures").collect()}
    assert {"ctx_overlay", "threshold_over_time", "eligible_constituents", "return_distributions", "sodd_vs_delta", "threshold_sweep"} <= figures and "sector_violation_rates" not in figures
    assert spark.read.parquet(f"{d}/figures/sodd_vs_delta.parquet").count() <= 30
    assert spark.read.option("header", True).csv(f"{d}/rates").count() == tables.read_table(spark, d, "headline_rates").count()
    with pytest.raises(AnalysisException):
        a = cli.parser().parse_args(["networks", "--stats-file", f"{d}/nowhere.parquet", "--data-dir", d])
        cli.STAGES[a.stage](spark, a)

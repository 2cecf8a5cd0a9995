"""Command line: ``python -m quadrille.cli <stage> --data-dir DIR ...``; every stage reads and writes tables of the folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import aggregates, graphs, labels, nulls, pairs, sweep, windows
from .session import prepare
from .sources import tables


def _inputs(spark: SparkSession, a) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    data = tables.load_data(spark, a.data_dir)
    elig = windows.first_windows(data["eligibility"], a.sample) if a.sample else data["eligibility"]
    bounds = elig.groupBy("window_id").agg(F.min("win_start").alias("win_start"), F.min("win_end").alias("win_end"))
    lab = labels.label_windows(bounds, a.crisis_source, a.crisis_threshold, a.vix_quantile, a.vix_agg)
    rows = windows.window_panel(data["returns"], elig, data["calendar"], a.window_days, a.step_days)
    return data, rows, bounds, lab


def analyze(spark: SparkSession, a) -> None:
    """The pair table by window, its summaries, and the simulated null."""
    _, rows, bounds, lab = _inputs(spark, a)
    out = a.out or a.data_dir
    path = tables.save_table(pairs.pair_window_stats(rows, bounds, a.window_days, a.n_min, a.theta_quantile, lab), out, "pair_window_stats", by=["window_id"])
    stats = spark.read.parquet(path)
    for name, df in (("headline_rates", aggregates.headline_rates(stats)), ("stat_hist", aggregates.stat_histograms(stats)), ("cell_summary", aggregates.cell_summary(stats)), ("scatter_subsample", aggregates.scatter_quota(stats))):
        tables.save_table(df, out, name)
    if not a.no_null_stream:
        tables.save_table(nulls.streamed_null_histogram(stats, rows, a.null_pairs_per_window, a.n_min, a.seed, a.theta_quantile), out, "classical_null_hist")
    if a.null:
        null = spark.read.parquet(tables.save_table(nulls.classical_null(stats, rows, a.n_min, a.null_max_pairs, a.seed, a.theta_quantile), out, "classical_null_stats"))
        tables.save_table(aggregates.null_overlay(stats, null), out, "ctx_overlay")
    if a.null_gate_stats:
        tables.save_table(nulls.null_gate_stats(stats, rows, a.gate_windows, a.gate_nodes, a.n_min, a.theta_quantile, a.seed), out, "classical_null_gate_stats")


def sweep_stage(spark: SparkSession, a) -> None:
    _, rows, _, lab = _inputs(spark, a)
    quantiles = tuple(float(q) for q in a.quantiles.split(",")) if a.quantiles else sweep.QUANTILES
    relaxed = sweep.relaxed_of(quantiles)
    out = sweep.threshold_sweep(rows, lab, a.window_days, quantiles, a.n_min, a.relaxed_n_min, relaxed)
    if relaxed and not a.no_sweep_null:
        swept = sweep.sweep_pairs(rows, a.window_days, relaxed, a.relaxed_n_min).join(F.broadcast(lab), "window_id")
        out = out.join(nulls.sweep_null_rates(swept, rows, relaxed, a.relaxed_n_min, seed=a.seed), ["theta_q", "regime"], "left")
        floor = nulls.matched_floor(swept.filter("valid"), ["theta_q", "regime"], seed=a.seed).withColumnRenamed("floor", "cbd_rate_smallN_floor")
        out = out.join(floor, ["theta_q", "regime"], "left")
    tables.save_table(out, a.out or a.data_dir, "threshold_sweep")


def reliability(spark: SparkSession, a) -> None:
    _, rows, bounds, _ = _inputs(spark, a)
    out = a.out or a.data_dir
    halves = spark.read.parquet(tables.save_table(sweep.split_half_weights(rows, a.window_days, a.n_min, a.theta_quantile), out, "split_half_edge_weights"))
    rel = spark.read.parquet(tables.save_table(sweep.split_half_reliability(halves, bounds), out, "s_odd_reliability"))
    topo = spark.read.parquet(tables.save_table(graphs.topology_reliability(halves, a.edge_quantile), out, "topology_reliability"))
    tables.save_table(graphs.reliability_checkpoint(topo, rel), out, "reliability_checkpoint")


def _given(spark: SparkSession, a, path: str | None, name: str, optional: bool = False) -> DataFrame | None:
    """The table at a path that was given, else the folder's own; a path that was given must be there."""
    if path:
        return tables.read_file(spark, path)
    try:
        return tables.read_table(spark, a.data_dir, name, processed_first=True)
    except FileNotFoundError:
        if optional:
            return None
        raise


def networks(spark: SparkSession, a) -> None:
    out = a.out or a.data_dir
    stats = _given(spark, a, a.stats_file, "pair_window_stats")
    episodes = labels.taxonomy(spark)
    tables.save_table(graphs.network_metrics(stats, a.edge_quantile, a.abs_threshold, episodes), out, "network_metrics")
    if a.robustness:
        excess = spark.read.parquet(tables.save_table(graphs.config_excess(stats, a.edge_quantile, a.n_rewire, a.seed, episodes), out, "network_metrics_excess"))
        tables.save_table(graphs.window_inference(excess, seed=a.seed), out, "window_level_inference")
    if a.no_mrqap:
        return
    if a.partialled:
        tables.save_table(graphs.qap_partialled(stats, a.mrqap_nperm, seed=a.seed, node_subsample=a.gate_nodes or None), out, "network_qap_partialled")
    real = spark.read.parquet(tables.save_table(graphs.qap_hierarchy(stats, a.mrqap_nperm, a.mrqap_windows or None, seed=a.seed, node_subsample=a.gate_nodes or None), out, "network_qap"))
    if (null := _given(spark, a, a.null_stats_file, "classical_null_gate_stats", optional=True)) is not None:
        gate = graphs.qap_hierarchy(null, a.mrqap_nperm, a.mrqap_windows or None, seed=a.seed, node_subsample=a.gate_nodes or None)
        tables.save_table(graphs.gate_summary(real, gate, _given(spark, a, a.reliability_file, "s_odd_reliability", optional=True), seed=a.seed), out, "network_gate_summary")


def figures(spark: SparkSession, a) -> None:
    """The data behind each figure whose tables are there, one table a figure, under ``figures`` of the output folder."""
    stats = _given(spark, a, a.stats_file, "pair_window_stats")
    null = _given(spark, a, a.null_file, "classical_null_stats", optional=True)
    read = lambda name: tables.read_optional(spark, a.data_dir, name)
    elig, ret, cal, swept, sectors = (read(n) for n in ("window_eligibility", "daily_returns", "trading_calendar", "threshold_sweep", "sectors"))
    out = {
        "cell_counts": lambda: aggregates.cell_count_boxes(stats),
        "statistic_distributions": lambda: aggregates.score_distributions(stats),
        "violation_rates": lambda: aggregates.violation_rates(stats),
        "sodd_vs_delta": lambda: aggregates.sample_pairs(stats, a.max_points, a.seed).select("s_odd", "delta", "ctx", "regime"),
        "crisis_runs": lambda: aggregates.crisis_runs(aggregates.regime_table(stats)),
        "coupling_amount": lambda: aggregates.coupling_amount(stats, a.abs_threshold),
    }
    if elig is not None:
        out["eligible_constituents"] = lambda: aggregates.eligible_over_time(elig, aggregates.regime_table(stats).select("window_id", "regime"))
    if ret is not None:
        ret = tables.conform(ret, schemas.RETURNS)
        out |= {"coverage_missingness": lambda: aggregates.coverage_by_year(ret), "return_distributions": lambda: aggregates.return_histogram(ret), "absolute_returns": lambda: aggregates.absolute_return_boxes(ret, "month")}
    if ret is not None and elig is not None and cal is not None:
        out["threshold_over_time"] = lambda: aggregates.threshold_band(pairs.thresholds(windows.window_panel(ret, elig, cal, a.window_days, a.step_days), a.theta_quantile))
    if null is not None:
        out["ctx_overlay"] = lambda: aggregates.null_overlay(stats, null)
    if swept is not None:
        out["threshold_sweep"] = lambda: swept
    if sectors is not None:
        out["sector_violation_rates"] = lambda: aggregates.sector_rates_sorted(stats, sectors)
    for name, table in out.items():
        tables.save_table(table(), a.out or a.data_dir, name, "figures")


def rebuild(spark: SparkSession, a) -> None:
    """Eligibility for other window lengths, from the same raw tables."""
    data = {n: tables.conform(tables.read_table(spark, a.data_dir, n), s) for n, s in (("membership", schemas.MEMBERSHIP), ("trading_calendar", schemas.CALENDAR))}
    tables.save_table(windows.window_eligibility(data["membership"], data["trading_calendar"], a.window_days, a.step_days), a.out or a.data_dir, "window_eligibility", subdir=None)


def extract(spark: SparkSession, a) -> None:
    """Raw tables from a database: members of the span, the calendar, their returns and identifiers, and windows' eligibility."""
    start, end = a.start, a.end
    options = {"user": a.user, "password": a.password} if a.user else {}
    members = tables.jdbc(spark, a.url, tables.membership_query(a.members_table, start, end), **options)
    members = spark.read.parquet(tables.save_table(tables.conform(members, schemas.MEMBERSHIP), a.data_dir, "membership", None))
    ids = [r["permno"] for r in members.select("permno").distinct().collect()]  # members of an index
    returns = spark.read.parquet(tables.save_table(tables.read_returns(spark, a.url, a.returns_table, ids, start, end, options), a.data_dir, "daily_returns", None))
    calendar = spark.read.parquet(tables.save_table(windows.trading_calendar(returns), a.data_dir, "trading_calendar", None))
    if a.names_table:
        tables.save_table(tables.identifiers(tables.jdbc(spark, a.url, f"SELECT * FROM {a.names_table}", **options), members), a.data_dir, "identifiers", None)
    tables.save_table(windows.window_eligibility(members, calendar, a.window_days, a.step_days), a.data_dir, "window_eligibility")


def list_stage(spark: SparkSession, a) -> None:
    tables.list_tables(spark, a.data_dir).show(1000, truncate=False)


def view(spark: SparkSession, a) -> None:
    df = tables.read_table(spark, a.data_dir, a.name)
    df.printSchema()
    tables.describe(df).show(truncate=False)
    df.show(a.n)


def csv(spark: SparkSession, a) -> None:
    tables.export_csv(tables.read_table(spark, a.data_dir, a.name), a.out or f"{a.data_dir}/{a.name}-csv", -1 if a.force and a.max_rows is None else a.max_rows)


STAGES = {"analyze": analyze, "sweep": sweep_stage, "reliability": reliability, "networks": networks, "figures": figures, "rebuild": rebuild, "extract": extract, "list": list_stage, "view": view, "csv": csv}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("name", nargs="?")
    for flag, kind, default in (
        ("--data-dir", str, "."), ("--out", str, None), ("--window-days", int, 60), ("--step-days", int, 21), ("--n-min", int, 10), ("--sample", int, None),
        ("--crisis-source", str, None), ("--crisis-threshold", float, None), ("--theta-quantile", float, 0.5), ("--relaxed-n-min", int, 3), ("--null-max-pairs", int, 2000),
        ("--gate-windows", int, 6), ("--gate-nodes", int, 60), ("--seed", int, 0), ("--edge-quantile", float, 0.05), ("--abs-threshold", float, 2.0),
        ("--mrqap-nperm", int, 199), ("--mrqap-windows", int, 8), ("--n-rewire", int, 20), ("-n", int, 10), ("--max-rows", int, None),
        ("--vix-quantile", float, 0.5), ("--vix-agg", str, "mean"), ("--null-pairs-per-window", int, 400), ("--quantiles", str, None), ("--url", str, None), ("--user", str, None), ("--password", str, None),
        ("--start", str, "1990-01-01"), ("--end", str, "2025-12-31"), ("--members-table", str, "members"), ("--returns-table", str, "returns"), ("--names-table", str, None),
        ("--stats-file", str, None), ("--null-stats-file", str, None), ("--reliability-file", str, None), ("--null-file", str, None), ("--max-points", int, 20_000),
    ):
        p.add_argument(flag, type=kind, default=default)
    for flag in ("--null", "--null-gate-stats", "--robustness", "--no-null-stream", "--no-sweep-null", "--no-mrqap", "--partialled", "--force"):
        p.add_argument(flag, action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName("quadrille").getOrCreate())
    STAGES[a.stage](spark, a)


if __name__ == "__main__":
    main()

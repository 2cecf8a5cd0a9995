"""One query for each operator of the engine, on the weekly brand panel of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scores import pooled_weight
from ..operators import aggregates, contexts, exogenous, graphs, labels, nulls, pairs, screening, sweep, windows
from ..session import prepare, scratch, stored
from ..sources import footers, tables, testdata
from ..streaming import legs, panel

WIDTH, STEP, N_MIN, N_MIN_LOW, Q = 60, 21, 10, 3, 0.5
#: Quantiles at which simulated pairs of this panel have cells enough.
SWEEP_NULL = (0.70, 0.75)


class Panel:
    """The inputs of the queries, each built when first used; with keep, window rows and the pair table are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, width: int = WIDTH, n_min: int = N_MIN, q: float = Q, keep: bool = True):
        self.spark, self.sf_dir, self.width, self.n_min, self.q = prepare(spark), sf_dir, width, n_min, q
        self.kept = stored if keep else lambda df, name: df

    @cached_property
    def returns(self) -> DataFrame:
        """Written once: calendar, spells, windows and rows all derive from it, and each would scan the facts again."""
        return stored(testdata.returns(self.spark, self.sf_dir), "returns")

    @cached_property
    def calendar(self) -> DataFrame:
        return stored(windows.trading_calendar(self.returns), "calendar")

    @cached_property
    def membership(self) -> DataFrame:
        return testdata.membership(self.returns)

    @cached_property
    def windows(self) -> DataFrame:
        return windows.hopping_windows(self.calendar, self.width, STEP)

    @cached_property
    def eligibility(self) -> DataFrame:
        return windows.window_eligibility(self.membership, self.calendar, self.width, STEP)

    @cached_property
    def rows(self) -> DataFrame:
        return self.kept(windows.window_panel(self.returns, self.eligibility, self.calendar, self.width, STEP), "rows")

    @cached_property
    def labels(self) -> DataFrame:
        return labels.label_windows(self.windows, "nber")

    @cached_property
    def stats(self) -> DataFrame:
        return self.kept(pairs.pair_window_stats(self.rows, self.windows, self.width, self.n_min, self.q, self.labels), "pairs")

    @cached_property
    def vix(self) -> DataFrame:
        return testdata.volatility(self.spark, self.sf_dir)

    @cached_property
    def sectors(self) -> DataFrame:
        return testdata.sectors(self.returns)

    @cached_property
    def episodes(self) -> DataFrame:
        return labels.taxonomy(self.spark)

    @cached_property
    def halves(self) -> DataFrame:
        return self.kept(sweep.split_half_weights(self.rows, self.width, self.n_min, self.q), "halves")

    @cached_property
    def weights(self) -> DataFrame:
        return graphs.edge_weights(self.stats)

    @cached_property
    def top(self) -> DataFrame:
        return graphs.top_edges(self.weights)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, without negative zeros; equal on every engine then."""
    return df.select(*[(F.round(c, 9) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on(f: Callable[[Panel], DataFrame], **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(Panel(spark, sf_dir, **options)))


_LOW = {"n_min": N_MIN_LOW}


#: What SQL can check of a graph's topology: all but its greedy communities.
TOPOLOGY = ("giant_frac", "avg_clustering")


def _topology(p: Panel) -> DataFrame:
    return _networks(p).drop("modularity", "n_communities")


def _half_topology(p: Panel) -> DataFrame:
    return graphs.topology_reliability(p.halves, metrics=TOPOLOGY)


def _round_trip(p: Panel, kind: str) -> DataFrame:
    """Eligibility written and read again, by window as Parquet, with a header and a schema as CSV."""
    folder = scratch(p.spark, "trip")
    df = p.eligibility.withColumn("WIN_END", F.col("win_end").cast("string")) if kind == "csv" else p.eligibility
    tables.save_table(df, folder, "window_eligibility", "processed", ["window_id"] if kind == "parquet" else None, kind)
    return tables.conform(tables.read_table(p.spark, folder, "window_eligibility"), schemas.ELIGIBILITY)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch(prepare(spark), "stream")
    out = panel.finished_totals(spark, f"{sf_dir}/events.parquet", store, late="2 days", every="1 day")
    return out.withColumn("total", F.round("total", 4) + F.lit(0.0))


def _streamed_pairs(p: Panel) -> DataFrame:
    """The panel's returns as a stream, with the windows that a watermark of 14 days has closed at its end."""
    store = scratch(p.spark, "stream")
    return legs.finished_pairs(p.spark, p.returns._stored_at, store, p.calendar, p.eligibility, p.width, STEP, p.n_min, p.q)


def _foreign_returns(p: Panel) -> DataFrame:
    """Returns under other names, prices with signs, numbers as text."""
    r = p.returns
    return r.select(F.col("permno").cast("string").alias("PERMNO"), F.col("date").cast("timestamp").alias("DlyCalDt"), F.col("ret").cast("string").alias("DLYRET"), (-F.col("permno")).alias("dlyprc"), F.lit("n/a").alias("dlyvol"))


def _networks(p: Panel) -> DataFrame:
    return graphs.network_metrics(p.stats, bound=2.0, episodes=p.episodes)


def _config(p: Panel) -> DataFrame:
    return p.kept(graphs.config_excess(p.stats, episodes=p.episodes), "excess")


def _reliability(p: Panel) -> DataFrame:
    return sweep.split_half_reliability(p.halves, p.windows)


def _qap(stats: DataFrame) -> DataFrame:
    """Every window that has members enough, with the permutations of the reference."""
    return graphs.qap_hierarchy(stats, max_windows=None, min_nodes=5)


def _gate(p: Panel) -> DataFrame:
    real = p.kept(_qap(p.stats), "qap")
    null = p.kept(_qap(nulls.null_gate_stats(p.stats, p.rows, None, None, p.n_min)), "qap-null")
    return graphs.gate_summary(real, null, _reliability(p))


def _sweep_null(quantiles=sweep.RELAXED_QUANTILES) -> Callable[[Panel], DataFrame]:
    def rates(p: Panel) -> DataFrame:
        swept = sweep.sweep_pairs(p.rows, p.width, quantiles, N_MIN_LOW).join(F.broadcast(p.labels), "window_id")
        return nulls.sweep_null_rates(p.kept(swept, "swept"), p.rows, quantiles, N_MIN_LOW)

    return rates


def _weighted(p: Panel) -> DataFrame:
    """A week is thin if its volume is under half the mean one of all brands."""
    volumes = p.kept(testdata.volumes(p.spark, p.sf_dir), "volumes")
    bar = volumes.agg((F.avg("vol") / 2).alias("bar")).first()["bar"] or 0.0
    return screening.weighted_pair_stats(p.rows, screening.trading_weights(volumes, bar), p.width, p.n_min)


def _labels(**kw) -> Callable[[Panel], DataFrame]:
    return lambda p: labels.label_by_volatility(p.windows, p.vix, **kw)


def _jaccard(p: Panel) -> DataFrame:
    return graphs.half_jaccard(p.halves)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # panel and windows
    "panel_returns": _on(lambda p: testdata.returns(p.spark, p.sf_dir)),
    "trading_calendar": _on(lambda p: p.calendar),
    "membership_spells": _on(lambda p: p.membership),
    "members_overlapping": _on(lambda p: tables.overlapping_members(p.membership, "1996-01-01", "1996-06-30").select("permno").distinct()),
    "hopping_windows": _on(lambda p: p.windows),
    "hopping_windows_w120": _on(lambda p: p.windows, width=120),
    "window_eligibility": _on(lambda p: p.eligibility),
    "eligible_per_window": _on(lambda p: windows.eligible_per_window(p.eligibility)),
    "eligible_summary": _on(lambda p: windows.eligible_summary(p.eligibility)),
    "eligible_over_time": _on(lambda p: aggregates.eligible_over_time(p.eligibility, p.labels)),
    "identifiers_distinct": _on(lambda p: tables.identifiers(p.sectors.withColumn("ticker", F.concat(F.lit("B"), F.col("permno").cast("string"))), p.membership)),
    "first_windows": _on(lambda p: windows.first_windows(p.eligibility, 3)),
    "window_panel": _on(lambda p: p.rows, keep=False),
    # pairs
    "leg_thresholds": _on(lambda p: pairs.thresholds(p.rows)),
    "leg_regimes": _on(lambda p: pairs.with_regimes(p.rows).select("window_id", "permno", "date", "x")),
    "pair_window_stats": _on(lambda p: p.stats, keep=False),
    "pair_window_stats_q75": _on(lambda p: p.stats, n_min=N_MIN_LOW, q=0.75),
    "pair_window_stats_w120": _on(lambda p: p.stats, width=120),
    "pair_skeleton": _on(lambda p: p.stats.select("window_id", "permno_a", "permno_b")),
    # labels
    "labels_none": _on(lambda p: labels.label_windows(p.windows)),
    "labels_spans": _on(lambda p: p.labels),
    "labels_vix_mean": _on(_labels(how="mean")),
    "labels_vix_median": _on(_labels(how="median")),
    "labels_vix_max": _on(_labels(how="max", q=0.75)),
    "labels_vix_fixed": _on(_labels(threshold=25.0)),
    "taxonomy_tags": _on(lambda p: labels.tag_windows(p.windows, p.episodes)),
    # summaries
    "headline_rates": _on(lambda p: aggregates.headline_rates(p.stats), **_LOW),
    "violation_rates": _on(lambda p: aggregates.violation_rates(p.stats), **_LOW),
    "stat_hist": _on(lambda p: aggregates.stat_histograms(p.stats), **_LOW),
    "stat_density": _on(lambda p: aggregates.density(aggregates.stat_histograms(p.stats), "regime"), **_LOW),
    "ctx_overlay": _on(lambda p: aggregates.summed_histogram(aggregates.stat_histograms(p.stats), "ctx"), **_LOW),
    "score_distributions": _on(lambda p: aggregates.score_distributions(p.stats), **_LOW),
    "coupling_amount": _on(lambda p: aggregates.coupling_amount(p.stats), **_LOW),
    "cell_summary": _on(lambda p: aggregates.cell_summary(p.stats), **_LOW),
    "cell_count_boxes": _on(lambda p: aggregates.cell_count_boxes(p.stats), **_LOW),
    "sector_rates": _on(lambda p: aggregates.sector_rates(p.stats, p.sectors), **_LOW),
    "sector_rates_sorted": _on(lambda p: aggregates.sector_rates_sorted(p.stats, p.sectors), **_LOW),
    "coverage_by_year": _on(lambda p: aggregates.coverage_by_year(p.returns)),
    "theta_band": _on(lambda p: aggregates.threshold_band(pairs.thresholds(p.rows))),
    "absret_month_box": _on(lambda p: aggregates.absolute_return_boxes(p.returns, "month")),
    "absret_quarter_box": _on(lambda p: aggregates.absolute_return_boxes(p.returns, "quarter")),
    "return_hist": _on(lambda p: aggregates.return_histogram(p.returns)),
    "index_equal_weight": _on(lambda p: aggregates.equal_weight_index(p.returns, testdata.index_levels(p.spark, p.sf_dir)).withColumns({c: F.round(F.ln(c), 6) for c in ("equal_weight", "index_level")})),
    "regime_table": _on(lambda p: aggregates.regime_table(p.stats)),
    "crisis_runs": _on(lambda p: aggregates.crisis_runs(aggregates.regime_table(p.stats))),
    "scatter_quota": _on(lambda p: aggregates.scatter_quota(p.stats), **_LOW),
    "sample_pairs": _on(lambda p: aggregates.sample_pairs(p.stats, 200).select("window_id", "permno_a", "permno_b", "s_odd"), **_LOW),
    "group_sample": _on(lambda p: aggregates.group_sample(pairs.valid_pairs(p.stats), 40, ["regime"]).select("regime", "window_id", "permno_a", "permno_b", "ctx"), **_LOW),
    "pooled_weights": _on(lambda p: pairs.valid_pairs(p.stats).select("window_id", "permno_a", "permno_b", pooled_weight([F.col(f"E{c}") for c in aggregates.CELLS], [F.col(f"N{c}") for c in aggregates.CELLS]).alias("w_pooled"))),
    # sweep and reliability
    "threshold_sweep": _on(lambda p: sweep.threshold_sweep(p.rows, p.labels)),
    "split_half_weights": _on(lambda p: p.halves),
    "split_half_reliability": _on(_reliability),
    # exogenous regime and generator
    "vix_regime_full": _on(lambda p: exogenous.volatility_regime(p.vix)),
    "vix_regime_rolling": _on(lambda p: exogenous.volatility_regime(p.vix, 20)),
    "exogenous_contrast": _on(lambda p: exogenous.exogenous_contrast(p.stats, p.rows, exogenous.volatility_regime(p.vix))),
    "generator_fit": _on(lambda p: exogenous.generator_fit(p.stats, p.rows)),
    # regimes known beforehand, and who counts less
    "lagged_volatility": _on(lambda p: contexts.lagged_volatility(p.returns)),
    "lagged_pair_stats": _on(lambda p: contexts.lagged_pair_stats(p.rows, p.returns, p.width, p.n_min), **_LOW),
    "announcement_days": _on(lambda p: contexts.rolled_events(testdata.announcements(p.spark, p.sf_dir), p.calendar)),
    "announcement_contrast": _on(lambda p: exogenous.exogenous_contrast(p.stats, p.rows, contexts.event_regime(p.calendar, testdata.announcements(p.spark, p.sf_dir)), N_MIN_LOW)),
    "announcement_contrast_around": _on(lambda p: exogenous.exogenous_contrast(p.stats, p.rows, contexts.event_regime(p.calendar, testdata.announcements(p.spark, p.sf_dir), 1, 1), N_MIN_LOW)),
    "weighted_pair_stats": _on(_weighted, **_LOW),
    "one_class_per_firm": _on(lambda p: screening.one_class_per_firm(p.eligibility, testdata.identifier_spells(p.returns), testdata.volumes(p.spark, p.sf_dir), p.calendar, p.width, STEP)),
    # nulls
    "classical_null": _on(lambda p: nulls.classical_null(p.stats, p.rows)),
    "classical_null_hist": _on(lambda p: aggregates.histogram(nulls.classical_null(p.stats, p.rows).filter("valid"), "ctx", aggregates.edges_of(aggregates.BINS["ctx"]))),
    "streamed_null_hist": _on(lambda p: nulls.streamed_null_histogram(p.stats, p.rows)),
    "ctx_null_overlay": _on(lambda p: aggregates.null_overlay(p.stats, p.kept(nulls.classical_null(p.stats, p.rows), "null"))),
    "placebo": _on(lambda p: nulls.permutation_placebo(p.stats, p.rows, n_perm=2)),
    "max_stat_null": _on(lambda p: nulls.max_stat_null(p.stats, p.rows)),
    "small_sample_null": _on(lambda p: nulls.small_sample_null(nulls.cell_sizes(pairs.valid_pairs(p.stats))), **_LOW),
    "finite_n_floor": _on(lambda p: nulls.finite_n_floors(nulls.cell_sizes(pairs.valid_pairs(p.stats))), **_LOW),
    "matched_floor": _on(lambda p: nulls.matched_floor(pairs.valid_pairs(p.stats), ["regime"]), **_LOW),
    "sweep_null_rates": _on(_sweep_null()),
    "sweep_null_rates_q70": _on(_sweep_null(SWEEP_NULL)),
    "null_gate_stats": _on(lambda p: nulls.null_gate_stats(p.stats, p.rows)),
    # graphs
    "edge_weights": _on(lambda p: p.weights),
    "top_edges": _on(lambda p: p.top),
    "abs_edges": _on(lambda p: graphs.absolute_edges(p.weights), **_LOW),
    "graph_density": _on(lambda p: graphs.density(p.weights, p.top)),
    "graph_clustering": _on(lambda p: graphs.clustering(p.weights, graphs.top_edges(p.weights, 0.2))),
    "graph_giant": _on(lambda p: graphs.giant_fraction(p.stats)),
    "graph_communities": _on(lambda p: graphs.graph_communities(p.stats)),
    "partition_modularity": _on(lambda p: graphs.partition_modularity(p.top.filter("graph = 's_odd'"), graphs.nodes_of(p.weights.filter("graph = 's_odd'")).withColumn("community", (F.col("node") / 10).cast("int")))),
    "edge_jaccard": _on(_jaccard),
    "network_topology": _on(_topology),
    "topology_by_regime": _on(lambda p: graphs.metrics_by_regime(_topology(p), TOPOLOGY)),
    "topology_by_type": _on(lambda p: graphs.metrics_by_type(_topology(p), TOPOLOGY)),
    "topology_over_time": _on(lambda p: _topology(p).select("graph", "win_start", *TOPOLOGY).orderBy("graph", "win_start")),
    "topology_inference": _on(lambda p: graphs.window_inference(_topology(p), metrics=TOPOLOGY, suffix="")),
    "half_topology": _on(_half_topology),
    "half_topology_checkpoint": _on(lambda p: graphs.reliability_checkpoint(_half_topology(p), _reliability(p), TOPOLOGY)),
    "network_metrics": _on(_networks),
    "metrics_by_regime": _on(lambda p: graphs.metrics_by_regime(_networks(p))),
    "metrics_over_time": _on(lambda p: _networks(p).orderBy("graph", "win_start")),
    "metrics_by_type": _on(lambda p: graphs.metrics_by_type(_networks(p))),
    "rewired_degrees": _on(lambda p: graphs.rewired_degrees(p.stats)),
    "rewired_edges": _on(lambda p: graphs.rewired_edges(p.stats)),
    "config_excess": _on(_config),
    "window_inference": _on(lambda p: graphs.window_inference(_config(p))),
    "qap_observed": _on(lambda p: graphs.qap_observed(p.stats)),
    "qap_permutation": _on(lambda p: _qap(p.stats)),
    "qap_partialled": _on(lambda p: graphs.qap_partialled(p.stats, min_nodes=5)),
    "qap_first_windows": _on(lambda p: graphs.qap_hierarchy(p.stats, n_perm=0, max_windows=8, min_nodes=5, node_subsample=12).select("window_id", "regime", "n_nodes", "r_pooled_e00", "r_pooled_s_odd", "r_e00_s_odd", "gate_r2_s_odd_on_pooled_e00", "gate_coef_e00")),
    "tier_histogram": _on(lambda p: graphs.tier_histogram(p.kept(_qap(p.stats), "qap"))),
    "tier_summary": _on(lambda p: graphs.tier_summary(_qap(p.stats))),
    "gate_summary": _on(_gate),
    "topology_reliability": _on(lambda p: graphs.topology_reliability(p.halves)),
    "reliability_checkpoint": _on(lambda p: graphs.reliability_checkpoint(graphs.topology_reliability(p.halves), _reliability(p))),
    # viewer
    "table_summary": _on(lambda p: tables.describe(p.returns)),
    "table_list": lambda spark, sf_dir: tables.list_tables(prepare(spark), sf_dir).select("name", "n_rows", "n_cols"),
    "table_spans": lambda spark, sf_dir: footers.table_spans(prepare(spark), sf_dir),
    "table_head": _on(lambda p: p.returns.orderBy("permno", "date").limit(20)),
    "human_sizes": lambda spark, sf_dir: prepare(spark).read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", tables.human_bytes_column(F.pow(F.lit(5.0), F.col("n_nationkey"))).alias("size")),
    # streams and files
    "streamed_totals": _streamed,
    "streamed_pair_stats": _on(_streamed_pairs, **_LOW),
    "round_trip_parquet": _on(lambda p: _round_trip(p, "parquet")),
    "round_trip_csv": _on(lambda p: _round_trip(p, "csv")),
    "returns_renamed": _on(lambda p: tables.clean_returns(_foreign_returns(p))),
}

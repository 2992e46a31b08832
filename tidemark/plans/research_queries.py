"""Registered queries on rank statistics, resampling and the evidence of a feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.score import INSIDER_DEFAULTS, INSTITUTIONAL_DEFAULTS
from tidemark.operators import evidence, ranking, resample, research
from tidemark.params import DEFAULT_WEIGHTS, EXPORT_COLUMNS, TUNABLE_BOUNDS
from tidemark.plans.driver_tables import Tables
from tidemark.plans.score_queries import _export, _features
from tidemark.session import materialize, shared_folder
from tidemark.sources import tables, writers

GROUP, TIE = ["split", "baseline"], ["as_of", "ticker"]


def _observations(t: Tables):
    _, f = _features(t)
    f = f.withColumns({c: F.round(c, 6) for c in ("score", "insider_score", "institutional_score")})
    return materialize(research.baseline_rows(f, 60), "observations")


def w12_average_ranks(spark, sf):
    """Average rank of every order line's quantity within its ship mode flag and status."""
    l = Tables(spark, sf).read("lineitem")
    out = ranking.average_ranks(l, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "l_extendedprice", "n", "rank")


def w13_top_bottom_buckets(spark, sf):
    """Rows per fifth at both ends of the score order."""
    placed = ranking.positions(_observations(Tables(spark, sf)), GROUP, ["score", *TIE])
    size = F.greatest(F.lit(1), F.floor(F.col("total") / 5))
    side = F.when(F.col("position") < size, "bottom").when(F.col("position") >= F.col("total") - size, "top")
    return placed.withColumn("side", side).filter("side is not null").select(
        "split", "baseline", "side", "as_of", "ticker", F.col("position").cast("long").alias("position"))


def b1_rank_ic(spark, sf):
    return research.rank_ic(_observations(Tables(spark, sf)), GROUP).select("split", "baseline", F.round("rank_ic", 9).alias("rank_ic"))


def b2_b3_spread_and_hit_rate(spark, sf):
    out = research.bucket_metrics(_observations(Tables(spark, sf)), GROUP, TIE)
    return out.select("split", "baseline", "n", *[F.round(c, 6).alias(c) for c in ("top_bottom_spread", "hit_rate")])


def b4_metrics_by_split(spark, sf):
    out = research.metrics(_observations(Tables(spark, sf)), GROUP, TIE)
    return out.select("split", "baseline", "n", *[F.round(c, 6).alias(c) for c in (
        "rank_ic", "top_bottom_spread", "hit_rate", "mean_forward_return")])


def b5_bootstrap_ci(spark, sf):
    return research.bootstrap_ci(_observations(Tables(spark, sf)), GROUP, TIE)


def u5_resampled_correlation(spark, sf):
    """A metric of the caller's, here Pearson's correlation, with an interval by replicates that copy no rows."""
    obs = _observations(Tables(spark, sf))
    return resample.metric_interval(obs, GROUP, [*GROUP, *TIE], resample.correlation_terms(F.col("score"), F.col("ret")), resample.correlation)


def b6_permutation_p(spark, sf):
    return research.permutation_pvalue(_observations(Tables(spark, sf)), GROUP, TIE)


def _weight_observations(t: Tables):
    _, f = _features(t)
    cols = [c for c in (*INSTITUTIONAL_DEFAULTS, *INSIDER_DEFAULTS, "days_since_last_buy") if c in f.columns]
    return f.withColumn("ret", F.col("forward_return_60d")).filter("ret is not null").select("as_of", "ticker", "ret", *cols)


def b7_weight_sets(spark, sf):
    obs = materialize(_weight_observations(Tables(spark, sf)), "observations")
    sets = {"default": DEFAULT_WEIGHTS, "funds": DEFAULT_WEIGHTS.with_(insider_cluster=10.0, dollar_conviction=0.0),
            "insiders": DEFAULT_WEIGHTS.with_(institutional_breadth=10.0, agreement_bonus=0.0)}
    out = research.evaluate_weight_sets(obs, sets, TIE)
    return out.select("weight_set", "n", *[F.round(c, 5).alias(c) for c in ("ic", "quantile_spread", "hit_rate", "objective")])


def b8_weight_search(spark, sf):
    best, before, after = research.optimize_weights(_weight_observations(Tables(spark, sf)), TIE)
    rows = [(name, float(getattr(best, name)), before, after) for name in TUNABLE_BOUNDS]
    return spark.createDataFrame(rows, "weight string, value double, objective_before double, objective_after double")


def _feature_file(t: Tables, fmt: str):
    path = shared_folder(t.spark, "features")
    # Nine tenths of the file are lists of filings.
    writers.write_features(_export(t), path, fmt, compression="gzip")
    return tables.read_feature_rows(t.spark, path, "csv" if fmt == "csv" else "json")


def s19_feature_rows_csv(spark, sf):
    rows = _feature_file(Tables(spark, sf), "csv")
    return rows.select("report_date", "ticker", "quadrant", F.coalesce("data_quality_flags", F.lit("")).alias("flags"),
                       F.col("score").cast("double").alias("score"))


def s19_feature_rows_jsonl(spark, sf):
    rows = _feature_file(Tables(spark, sf), "jsonl")
    return rows.select("report_date", "ticker", "fund_moves", F.col("forward_return_20d").cast("double").alias("forward_return_20d"))


def a13_evidence(spark, sf):
    return evidence.evidence(_feature_file(Tables(spark, sf), "csv"))


def a13_evidence_counts(spark, sf):
    return evidence.evidence_counts(_feature_file(Tables(spark, sf), "csv"))


def a14_manifest(spark, sf):
    return evidence.manifest(_feature_file(Tables(spark, sf), "csv"))


def a14_row_errors(spark, sf):
    """Row errors of a feature file with some tickers and scores spoilt."""
    rows = _feature_file(Tables(spark, sf), "csv").withColumns({
        "score": F.when(F.col("quadrant") == "divergent", "n/a").otherwise(F.col("score")),
        "weight_version": F.when(F.col("quadrant") == "conviction", "other").otherwise(F.col("weight_version")),
    })
    return evidence.row_errors(rows).unionByName(
        evidence.version_mismatches(rows).select("field", F.concat(F.lit("version:"), "value").alias("error"), "n"))


def a31_content_hash(spark, sf):
    """The fingerprint of the order lines' keys and flags."""
    l = Tables(spark, sf).read("lineitem")
    return evidence.content_hash(l.select("l_suppkey", "l_orderkey", "l_returnflag", "l_partkey", "l_linestatus", "l_linenumber"))


def a32_evidence_review(spark, sf):
    out = evidence.evidence_review(_feature_file(Tables(spark, sf), "csv"))
    return out.select("status", F.array_join("blockers", ";").alias("blockers"), F.array_join("warnings", ";").alias("warnings"))


def k9_feature_summary(spark, sf):
    return writers.feature_summary(_feature_file(Tables(spark, sf), "csv"))


def u5_custom_metric(spark, sf):
    """A caller's own metric per group: the mean return of the better half by score, written
    as one aggregate over placed rows."""
    placed = ranking.positions(_observations(Tables(spark, sf)), GROUP, ["score", *TIE])
    half = F.col("position") * 2 >= F.col("total")
    return placed.groupBy(*GROUP).agg(F.round(F.avg(F.when(half, F.col("ret"))), 6).alias("better_half"))


def b8_weight_sweep(spark, sf):
    """Weights after four passes of a sweep, with the objective before and after."""
    return research.sweep_weights(_weight_observations(Tables(spark, sf)), TIE)


QUERIES = {f.__name__: f for f in (
    w12_average_ranks, w13_top_bottom_buckets, b1_rank_ic, b2_b3_spread_and_hit_rate, b4_metrics_by_split,
    b5_bootstrap_ci, u5_resampled_correlation, b6_permutation_p, b7_weight_sets, b8_weight_search, b8_weight_sweep, s19_feature_rows_csv,
    s19_feature_rows_jsonl, a13_evidence, a13_evidence_counts, a14_manifest, a14_row_errors,
    a31_content_hash, a32_evidence_review, k9_feature_summary, u5_custom_metric,
)}

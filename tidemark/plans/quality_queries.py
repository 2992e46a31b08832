"""Registered queries on data quality, over the flawed variant of the filings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import quality
from tidemark.plans.driver_tables import Tables
from tidemark.plans.filing_queries import money, ratio


def _inputs(spark, sf):
    t = Tables(spark, sf)
    resolved = t.chain(flawed=True).withColumn("total_value", F.round("total_value", 2))
    return resolved.select("cik", "report_date", "accession", "form", "filing_date", "total_value", "n_positions"), t.flawed_funds()


def w4_aum_jumps(spark, sf):
    resolved, _ = _inputs(spark, sf)
    return quality.aum_jumps(resolved).select(
        "cik", "prev_report_date", "report_date", ratio("ratio"), "direction", "severity")


def w4_aum_jumps_low_threshold(spark, sf):
    """The same rule with a threshold of three, on the unchanged filings."""
    resolved = Tables(spark, sf).resolved().withColumn("total_value", F.round("total_value", 2))
    return quality.aum_jumps(resolved, 3.0).select("cik", "report_date", ratio("ratio"), "direction", "severity")


def w5_unit_candidates(spark, sf):
    resolved, _ = _inputs(spark, sf)
    return quality.unit_candidates(resolved).select(
        "cik", "report_date", "next_report_date", ratio("neighbor_ratio"),
        F.round("ratio_to_neighbor_geomean", 8).alias("ratio_to_neighbor_geomean"), "action")


def w8_stale_funds(spark, sf):
    resolved, funds = _inputs(spark, sf)
    return quality.stale_funds(resolved, funds).select(
        "cik", "label", "latest_dataset_quarter", "latest_fund_quarter", "quarters_behind")


def w17_temporal_scope(spark, sf):
    resolved, funds = _inputs(spark, sf)
    return quality.findings(resolved, funds).groupBy("kind", "temporal_scope").agg(F.count(F.lit(1)).alias("n"))


def a9_signal_quarter(spark, sf):
    resolved, _ = _inputs(spark, sf)
    return quality.signal_quarter(resolved)


def a10_duplicate_labels(spark, sf):
    _, funds = _inputs(spark, sf)
    return quality.duplicate_labels(funds).select("normalized_label", "cik", "label", "n_funds")


def f20_severity_and_worst_status(spark, sf):
    """Worst status per fund and the severity of its largest jump."""
    resolved, funds = _inputs(spark, sf)
    gate = quality.quality_gate(resolved, funds).select("cik", F.col("status_rank").cast("long").alias("status_rank"))
    jumps = quality.aum_jumps(resolved).groupBy("cik").agg(F.max("ratio").alias("ratio"))
    from tidemark.functions.texts import severity
    return gate.join(jumps, "cik").select("cik", "status_rank", severity(F.col("ratio")).alias("severity"))


def l5_findings_in_order(spark, sf):
    """Jump findings with the current quarter first, then by ratio."""
    resolved, funds = _inputs(spark, sf)
    jumps = quality.findings(resolved, funds).filter("kind = 'aum_jump'").withColumn("size", F.round("size", 6))
    return jumps.orderBy(
        (F.col("temporal_scope") != "current_quarter"), F.col("size").desc(), "cik", "event_quarter"
    ).select("cik", "event_quarter", "temporal_scope", "size")


def v2_quality_summary(spark, sf):
    resolved, funds = _inputs(spark, sf)
    return quality.quality_summary(resolved, funds)


def v3_quality_gate(spark, sf):
    resolved, funds = _inputs(spark, sf)
    return quality.quality_gate(resolved, funds).select(
        "cik", "label", "status", "signal_eligible", "series_points", F.array_join("reasons", ";").alias("reasons"))


def v3_gate_summary(spark, sf):
    resolved, funds = _inputs(spark, sf)
    return quality.gate_summary(quality.quality_gate(resolved, funds))


def p19_trusted_funds(spark, sf):
    """Filings left per quarter when only trusted funds may speak."""
    resolved, funds = _inputs(spark, sf)
    trusted = quality.trusted_funds(quality.quality_gate(resolved, funds))
    return resolved.join(trusted.select("cik"), "cik", "left_semi").groupBy("report_date").agg(
        F.count(F.lit(1)).alias("filings"), money2("total_value"))


def money2(c):
    return F.round(F.sum(c), 2).alias(c)


def a28_content_check(spark, sf):
    """Whether the tables hold enough to publish from."""
    t = Tables(spark, sf)
    resolved, funds = _inputs(spark, sf)
    filings = t.filings(t.flawed_lines())
    k = F.lit(1).alias("_k")
    out = (
        funds.agg(F.count(F.lit(1)).alias("funds")).select("*", k)
        .join(filings.agg(F.count(F.lit(1)).alias("filings")).select("*", k), "_k")
        .join(resolved.agg(F.count(F.lit(1)).alias("latest_filings")).select("*", k), "_k")
        .join(quality.quality_summary(resolved, funds).select("current_unit_scale_candidates", k), "_k")
        .drop("_k")
    )
    full = (F.col("funds") > 0) & (F.col("filings") > 0) & (F.col("latest_filings") > 0)
    return out.withColumn("content", F.when(full, "pass").otherwise("fail")).withColumn(
        "data_quality", F.when(F.col("current_unit_scale_candidates") > 0, "fail").otherwise("pass"))


QUERIES = {f.__name__: f for f in (
    w4_aum_jumps, w4_aum_jumps_low_threshold, w5_unit_candidates, w8_stale_funds,
    w17_temporal_scope, a9_signal_quarter, a10_duplicate_labels, f20_severity_and_worst_status,
    l5_findings_in_order, v2_quality_summary, v3_quality_gate, v3_gate_summary,
    p19_trusted_funds, a28_content_check,
)}

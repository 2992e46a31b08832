"""Data-quality findings on fund value series and the gate built on them.

Input is one resolved filing per (fund, quarter), so windows run over the quarters of
one fund.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.texts import severity
from tidemark.operators.holdings import current_filing
from tidemark.params import (
    AUM_JUMP_THRESHOLD, PARTIAL_AMENDMENT_MAX_POSITIONS, SIGNAL_QUARTER_MIN_FUNDS,
    SIGNAL_QUARTER_MIN_SHARE, STATUS_RANK, UNIT_MAX_NEIGHBOR_RATIO, UNIT_RATIO_HIGH,
    UNIT_RATIO_LOW,
)


def signal_quarter(resolved: DataFrame) -> DataFrame:
    """One row: the newest quarter that enough funds have as their latest, else the newest."""
    per_date = current_filing(resolved).groupBy("report_date").agg(F.count(F.lit(1)).alias("n"))
    facts = per_date.agg(
        F.sum("n").alias("funds"),
        F.max("report_date").alias("newest"),
        F.collect_list(F.struct("report_date", "n")).alias("counts"),
    )
    needed = F.least(
        F.lit(SIGNAL_QUARTER_MIN_FUNDS),
        F.greatest(F.lit(1), F.ceil(F.col("funds") * SIGNAL_QUARTER_MIN_SHARE)),
    )
    enough = F.filter("counts", lambda c: c["n"] >= needed)
    return facts.select(
        F.coalesce(
            F.array_max(F.transform(enough, lambda c: c["report_date"])), F.col("newest")
        ).alias("current_quarter")
    )


def temporal_scope(event: Column, current: Column) -> Column:
    return (
        F.when(event.isNull() | current.isNull(), "unknown")
        .when(event == current, "current_quarter")
        .when(event < current, "historical")
        .otherwise("outside_current_quarter")
    )


def _with_scope(findings: DataFrame, quarter: DataFrame, event: str) -> DataFrame:
    """Attach the signal quarter (a one-row scalar) and the scope of each finding."""
    out = findings.withColumn("current_quarter", quarter.scalar())
    scope = temporal_scope(F.col(event), F.col("current_quarter"))
    return out.withColumn("temporal_scope", scope).withColumn(
        "affects_current_quarter", F.col("temporal_scope") == "current_quarter"
    )


def aum_jumps(resolved: DataFrame, threshold: float = AUM_JUMP_THRESHOLD) -> DataFrame:
    """Adjacent stored quarters whose value differs by at least ``threshold`` times."""
    threshold = max(float(threshold), 1.0)
    by_fund = Window.partitionBy("cik").orderBy("report_date")
    pv, cv = F.col("prev_value"), F.col("total_value")
    return (
        resolved.withColumns(
            {
                "prev_value": F.lag("total_value").over(by_fund),
                "prev_report_date": F.lag("report_date").over(by_fund),
            }
        )
        .filter((pv > 0) & (cv > 0))
        .withColumn("ratio", F.greatest(cv / pv, pv / cv))
        .filter(F.col("ratio") >= threshold)
        .withColumn("direction", F.when(cv > pv, "up").otherwise("down"))
        .withColumn("severity", severity(F.col("ratio")))
        .select("cik", "accession", "prev_report_date", "report_date", "prev_value",
                "total_value", "ratio", "direction", "severity")
    )


def unit_candidates(resolved: DataFrame, low: float = UNIT_RATIO_LOW, high: float = UNIT_RATIO_HIGH,
                    max_neighbor_ratio: float = UNIT_MAX_NEIGHBOR_RATIO) -> DataFrame:
    """Quarters about 1000 times off the geometric mean of two comparable neighbours."""
    by_fund = Window.partitionBy("cik").orderBy("report_date")
    pv, cv, nv = F.col("prev_value"), F.col("total_value"), F.col("next_value")
    ratio = F.col("ratio_to_neighbor_geomean")
    return (
        resolved.withColumns(
            {
                "prev_value": F.lag("total_value").over(by_fund),
                "next_value": F.lead("total_value").over(by_fund),
                "next_report_date": F.lead("report_date").over(by_fund),
            }
        )
        .filter((pv > 0) & (cv > 0) & (nv > 0))
        .withColumn("neighbor_ratio", F.greatest(pv / nv, nv / pv))
        .filter(F.col("neighbor_ratio") <= max_neighbor_ratio)
        .withColumn("ratio_to_neighbor_geomean", cv / F.sqrt(pv * nv))
        .withColumn(
            "action",
            F.when(ratio.between(1 / high, 1 / low), "MULTIPLY_1000").when(
                ratio.between(low, high), "DIVIDE_1000"
            ),
        )
        .filter("action is not null")
        .select("cik", "accession", "report_date", "next_report_date", "total_value",
                "neighbor_ratio", "ratio_to_neighbor_geomean", "action")
    )


def stale_funds(resolved: DataFrame, funds: DataFrame, all_resolved: DataFrame | None = None) -> DataFrame:
    """Funds whose newest quarter lies before the signal quarter, or that never filed.
    ``all_resolved`` gives the calendar of quarters when ``resolved`` is restricted."""
    calendar = (all_resolved if all_resolved is not None else resolved).select("report_date").distinct()
    ranks = calendar.agg(F.array_sort(F.collect_set("report_date")).alias("dates"))
    current = current_filing(resolved).select("cik", F.col("report_date").alias("latest_fund_quarter"))
    rank = lambda c: F.array_position("dates", c).cast("long")
    return (
        funds.join(current, "cik", "left")
        .withColumn("latest_dataset_quarter", signal_quarter(resolved).scalar())
        .withColumn("dates", ranks.scalar())
        .withColumn(
            "quarters_behind",
            F.when(F.col("latest_fund_quarter").isNull(), F.size("dates").cast("long")).otherwise(
                rank(F.col("latest_dataset_quarter")) - rank(F.col("latest_fund_quarter"))
            ),
        )
        .filter(F.col("latest_fund_quarter").isNull() | (F.col("quarters_behind") > 0))
        .drop("dates")
    )


def normalized_label(c: Column | str = "label") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def duplicate_labels(funds: DataFrame) -> DataFrame:
    """Labels that, ignoring case and spacing, belong to several ciks; one row per cik."""
    keyed = funds.withColumn("normalized_label", normalized_label()).filter("normalized_label <> ''")
    shared = keyed.groupBy("normalized_label").agg(F.count(F.lit(1)).alias("n_funds")).filter("n_funds > 1")
    return keyed.join(shared, "normalized_label")


def findings(resolved: DataFrame, funds: DataFrame, threshold: float = AUM_JUMP_THRESHOLD) -> DataFrame:
    """All findings in one schema: kind, fund, event quarter, scope, size and reason."""
    quarter = signal_quarter(resolved)
    null = lambda t: F.lit(None).cast(t)
    jumps = _with_scope(aum_jumps(resolved, threshold), quarter, "report_date").select(
        F.lit("aum_jump").alias("kind"), "cik", F.col("report_date").alias("event_quarter"),
        "temporal_scope", F.col("ratio").alias("size"),
        F.concat_ws("|", "severity", "direction").alias("detail"),
    )
    units = unit_candidates(resolved).withColumn(
        "impact_quarter", F.coalesce("next_report_date", "report_date")
    )
    units = _with_scope(units, quarter, "impact_quarter").select(
        F.lit("unit_scale_candidate").alias("kind"), "cik", F.col("impact_quarter").alias("event_quarter"),
        "temporal_scope", F.col("ratio_to_neighbor_geomean").alias("size"), F.col("action").alias("detail"),
    )
    stale = stale_funds(resolved, funds).select(
        F.lit("stale_fund").alias("kind"), "cik", F.col("latest_fund_quarter").alias("event_quarter"),
        F.lit("current_quarter").alias("temporal_scope"), F.col("quarters_behind").cast("double").alias("size"),
        F.lit("high").alias("detail"),
    )
    duplicates = duplicate_labels(funds).select(
        F.lit("duplicate_label").alias("kind"), "cik", null("date").alias("event_quarter"),
        F.lit("current_quarter").alias("temporal_scope"), F.col("n_funds").cast("double").alias("size"),
        F.col("normalized_label").alias("detail"),
    )
    return jumps.unionByName(units).unionByName(stale).unionByName(duplicates)


def quality_summary(resolved: DataFrame, funds: DataFrame, threshold: float = AUM_JUMP_THRESHOLD) -> DataFrame:
    """One-row report: how many findings of each kind, now and in the past, and the status.
    Duplicate labels are counted once per label."""
    f = findings(resolved, funds, threshold)
    one = f.withColumn("unit", F.when(F.col("kind") == "duplicate_label", F.col("detail")).otherwise(
        F.concat_ws("|", "cik", "event_quarter", "detail")))
    distinct = one.groupBy("kind", "unit").agg(F.min("temporal_scope").alias("temporal_scope"))
    n = lambda kind, scope=None: F.count_if(
        (F.col("kind") == kind) & (F.lit(True) if scope is None else F.col("temporal_scope") == scope)
    )
    current = "current_quarter"
    counts = distinct.agg(
        n("aum_jump").alias("aum_jump_warnings"),
        n("aum_jump", current).alias("current_aum_jump_warnings"),
        n("aum_jump", "historical").alias("historical_aum_jump_warnings"),
        n("stale_fund").alias("stale_funds"),
        n("duplicate_label").alias("duplicate_labels"),
        n("unit_scale_candidate").alias("unit_scale_candidates"),
        n("unit_scale_candidate", current).alias("current_unit_scale_candidates"),
        n("unit_scale_candidate", "historical").alias("historical_unit_scale_candidates"),
        F.count_if(F.col("temporal_scope") == current).alias("current_review_items"),
        F.count_if(F.col("temporal_scope") == "historical").alias("historical_review_items"),
        F.count_if(~F.col("temporal_scope").isin(current, "historical")).alias("outside_current_quarter_review_items"),
        F.count(F.lit(1)).alias("review_items"),
    )
    series = resolved.agg(
        F.count_distinct("cik").alias("funds_scanned"), F.count(F.lit(1)).alias("series_points")
    )
    one_key = F.lit(1).alias("_k")
    return (
        counts.select("*", one_key).join(series.select("*", one_key), "_k").drop("_k")
        .withColumn("current_quarter", signal_quarter(resolved).scalar())
        .withColumn("status", F.when(F.col("review_items") > 0, "review").otherwise("ok"))
        .withColumn("current_status", F.when(F.col("current_review_items") > 0, "review").otherwise("ok"))
    )


def gate_reasons(resolved: DataFrame, funds: DataFrame, threshold: float = AUM_JUMP_THRESHOLD) -> DataFrame:
    """(cik, status, code): why a fund is held back."""
    f = findings(resolved, funds, threshold)
    now = F.col("temporal_scope") == "current_quarter"
    status = (
        F.when(F.col("kind") == "stale_fund", "stale")
        .when(F.col("kind") == "aum_jump", F.when(F.col("detail").startswith("critical"), "quarantined").otherwise("degraded"))
        .otherwise("quarantined")
    )
    code = F.when(F.col("kind") == "aum_jump", "current_aum_jump").otherwise(F.col("kind"))
    from_findings = f.filter(now).select("cik", status.alias("status"), code.alias("code"))
    current = current_filing(resolved)
    missing = funds.join(current.select("cik"), "cik", "left_anti").select(
        "cik", F.lit("quarantined").alias("status"), F.lit("missing_latest_filing").alias("code")
    )
    partial = current.filter(
        F.col("form").endswith("/A")
        & (F.coalesce("n_positions", F.lit(0)) <= PARTIAL_AMENDMENT_MAX_POSITIONS)
    ).select("cik", F.lit("quarantined").alias("status"), F.lit("partial_amendment_latest").alias("code"))
    return from_findings.unionByName(missing).unionByName(partial)


def quality_gate(resolved: DataFrame, funds: DataFrame, threshold: float = AUM_JUMP_THRESHOLD) -> DataFrame:
    """One row per fund: worst status, whether signals may use it, and the reasons."""
    rank = F.lit(0)
    for name, value in STATUS_RANK.items():
        rank = F.when(F.col("status") == name, value).otherwise(rank)
    reasons = gate_reasons(resolved, funds, threshold).withColumn("rank", rank)
    per_fund = reasons.groupBy("cik").agg(
        F.max("rank").alias("status_rank"), F.array_sort(F.collect_set("code")).alias("reasons")
    )
    points = resolved.groupBy("cik").agg(F.count(F.lit(1)).alias("series_points"))
    status_names = F.array(*[F.lit(s) for s in STATUS_RANK])
    return (
        funds.select("cik", "label").join(per_fund, "cik", "left").join(points, "cik", "left")
        .withColumn("status_rank", F.coalesce("status_rank", F.lit(0)))
        .withColumn("status", F.element_at(status_names, F.col("status_rank") + 1))
        .withColumn("signal_eligible", F.col("status_rank") == 0)
        .withColumn("series_points", F.coalesce("series_points", F.lit(0)))
        .withColumn("reasons", F.coalesce("reasons", F.array(F.lit("passed_automated_quality_gate"))))
    )


def gate_summary(gate: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_funds")
    return gate.agg(
        F.count(F.lit(1)).alias("active_funds"),
        *[n(s) for s in STATUS_RANK],
        F.count_if("signal_eligible").alias("signal_eligible_funds"),
    ).withColumn(
        "status", F.when(F.col("trusted_funds") == F.col("active_funds"), "ok").otherwise("gated")
    )


def trusted_funds(gate: DataFrame) -> DataFrame:
    return gate.filter("signal_eligible").select("cik", "label")

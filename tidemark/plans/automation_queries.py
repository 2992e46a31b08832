"""Registered queries on the automated snapshot runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import watch
from tidemark.plans.driver_tables import Tables
from tidemark.plans.workspace_queries import _as_stream, _flow, stamp
from tidemark.session import shared_folder
from tidemark.streaming import jobs
from tidemark.streaming.automation import SnapshotRuns
from tidemark.streaming.jobs import latest_state


def _saved(t: Tables):
    """Saved watchlists with their filters as JSON text; of every 17 one is cut off and one has a word for a number."""
    k = F.substring("watchlist_id", 2, 20).cast("long") % 17
    text = F.to_json(F.struct(
        F.col("actions").alias("action"), F.col("moves").alias("move"), "min_score", "min_holders", "min_buyers", "max_13f_value_usd"))
    broken = F.when(k == 3, '{"action": ["alert"').when(k == 5, '{"min_score": "high"}')
    kept = t.watchlists().withColumn("filters", F.coalesce(broken, text))
    return kept.select("key_id", "watchlist_id", "name", "tickers", "filters", "enabled", "frequency", "updated_at")


def _runs(spark, sf) -> SnapshotRuns:
    """Three runs: at the ends of the last two quarters that have a flow, and two days later."""
    t = Tables(spark, sf)
    flow = _flow(t)
    last = flow.select("report_date").distinct().orderBy(F.col("report_date").desc()).limit(2)
    noon = lambda c, days=0: F.to_timestamp(F.date_add(c, days)) + F.expr("INTERVAL 12 HOURS")
    ticks = last.agg(F.min("report_date").alias("a"), F.max("report_date").alias("b")).select(
        F.array(noon("a"), noon("b"), noon("b", 2)).alias("at"))
    path = shared_folder(spark, "ticks")
    for place in range(3):
        ticks.select(F.get("at", F.lit(place)).alias("run_at")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("run_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)

    def flow_at(now):
        newest = flow.where(F.col("report_date") <= F.to_date(now)).agg(F.max("report_date").alias("d"))
        return flow.where(F.col("report_date") == newest.scalar()).drop("report_date")

    runs = SnapshotRuns(spark, shared_folder(spark, "snapshot-runs"), _saved(t), t.api_keys(), flow_at)
    runs.follow(stream)
    return runs


def st11_run_outcomes(spark, sf):
    """Every watchlist that was due in a run: its signals, or why it could not be run."""
    runs = _runs(spark, sf)
    return runs.table("outcomes").join(runs.table("runs").select("batch_id", "run_at", "ok"), "batch_id").select(
        stamp("run_at"), "watchlist_id", "frequency", "signals", "error", "ok")


def st11_run_alerts(spark, sf):
    """The alerts after all runs: first seen in one, refreshed by later ones."""
    alerts = latest_state(_runs(spark, sf).table("alerts"), watch.ALERT_KEY)
    return alerts.select("key_id", "watchlist_id", "ticker", "action", F.col("severity").cast("long").alias("severity"), "status",
                         "reason_score", stamp("first_seen_at"), stamp("last_seen_at"))


def st11_run_deltas(spark, sf):
    """What changed in each snapshot against the watchlist's snapshot before."""
    runs = _runs(spark, sf)
    at = runs.table("snapshots").select("snapshot_id", "created_at", F.col("baseline_snapshot_id").isNotNull().alias("has_baseline"))
    return runs.table("deltas").drop("batch_id").join(at, "snapshot_id").select(
        stamp("created_at"), "watchlist_id", "ticker", "change", "from_action", "to_action", "from_score", "to_score",
        "action_changed", "score_changed", "has_baseline")


def st13_activity(spark, sf):
    """Activity of the runs: an event for each snapshot and each failure."""
    return _runs(spark, sf).table("activity").select("key_id", "event_type", "entity_id", "title", "detail", stamp("created_at"))


def st13_operator_events(spark, sf):
    """Keys created and revoked as a stream of events that comes twice; each is kept once, with its texts cut."""
    k = Tables(spark, sf).api_keys()
    event = lambda name, at: F.struct(F.lit(name).alias("event_type"), F.col(at).alias("created_at"))
    events = k.select("key_id", "label", F.explode(F.array(event("api_key.created", "created_at"), event("api_key.revoked", "revoked_at"))).alias("e")).where("e.created_at IS NOT NULL")
    events = events.select(
        F.concat_ws("|", "key_id", "e.event_type").alias("id"), "key_id", "e.event_type", F.lit("api_key").alias("entity_type"), F.col("key_id").alias("entity_id"),
        F.repeat(F.concat("label", F.lit(" ")), F.lit(40)).alias("title"), "e.created_at")
    stream = _as_stream(events.unionByName(events), "operator-events")
    log = jobs.updates_table(jobs.event_appends(stream, "1 day"), "operator-log", "append")
    return log.select("id", "key_id", "event_type", F.md5("title").alias("title_md5"), F.length("title").cast("long").alias("title_length"), stamp("created_at"))


QUERIES = {f.__name__: f for f in (st11_run_outcomes, st11_run_alerts, st11_run_deltas, st13_activity, st13_operator_events)}

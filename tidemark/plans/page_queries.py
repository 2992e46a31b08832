"""Registered queries on whole pages and reports, as long tables of sections."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.operators import audit, holdings, pages, quality, watch
from tidemark.plans.automation_queries import _runs
from tidemark.plans.driver_tables import Tables
from tidemark.plans.workspace_queries import _closeout, _flow, _now_flow, now, stamp
from tidemark.session import shared_folder
from tidemark.sources import writers
from tidemark.streaming.jobs import latest_state


def _entries(df):
    """Sections with their fields as columns."""
    keys = [c for c in df.columns if c not in ("section", "place", "available", "entry")]
    fields = [stamp("entry.at", "at") if f == "at" else F.col(f"entry.{f}").alias(f) for f in pages.FIELDS]
    return df.select(*keys, "section", "place", "available", *fields)


def v5_fund_series(spark, sf):
    """The value of every fund, quarter by quarter."""
    t = Tables(spark, sf)
    series = holdings.value_timeline(t.chain().withColumn("total_value", F.round("total_value", 2)))
    text = F.array_join(F.transform("series", lambda p: F.concat_ws("=", p["report_date"].cast("string"), p["n_positions"].cast("string"))), ";")
    return t.funds().join(series, "cik", "left").select(
        "cik", "label", F.size("series").cast("long").alias("n_quarters"), text.alias("positions_by_quarter"),
        F.round(F.aggregate("series", F.lit(0.0), lambda s, p: s + p["total_value"]), 2).alias("value_of_all_quarters"),
        F.element_at("series", -1)["total_value"].alias("newest_value"))


def _fund_pages(t: Tables):
    chain, funds = t.chain(flawed=True), t.flawed_funds()
    newest = holdings.current_filing(chain.select("cik", "report_date")).select("cik", "report_date")
    rounded = chain.withColumn("total_value", F.round("total_value", 2))
    gate = quality.quality_gate(rounded, funds)
    of_newest = lambda df: df.join(newest, ["cik", "report_date"], "left_semi")
    m = of_newest(t.moves(flawed=True)).withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn("share_change_pct", F.round("share_change_pct", 9))
    filed = gate.join(newest.select("cik"), "cik", "left_semi")
    found = quality.findings(rounded, funds).join(newest.select("cik"), "cik", "left_semi").withColumn("detail", F.split_part("detail", F.lit("|"), F.lit(1)))
    return pages.fund_pages(chain, of_newest(t.snapshots(flawed=True)), m, filed, found)


def v6_fund_page(spark, sf):
    """Every fund's page: filings, positions, moves, findings and quarters."""
    return _entries(_fund_pages(Tables(spark, sf)))


def p18_page_windows(spark, sf):
    """How many entries each section of a fund's page returns, and how many there are."""
    return pages.result_windows(_fund_pages(Tables(spark, sf)), "cik")


def v7_ticker_page(spark, sf):
    """Every ticker's page in every quarter: score, confidence, holders, movements and excluded funds."""
    t = Tables(spark, sf)
    gate = quality.quality_gate(t.chain(flawed=True).withColumn("total_value", F.round("total_value", 2)), t.flawed_funds())
    m = t.moves(flawed=True).withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn("share_change_pct", F.round("share_change_pct", 9))
    return _entries(pages.ticker_pages(m, gate, _flow(t)))


def v8_preview_links(spark, sf):
    """The preview of the tickers that customers watch, with links to page and data of each."""
    t = Tables(spark, sf)
    named = t.watchlists().select(F.explode("tickers").alias("ticker")).distinct()
    return watch.with_links(watch.watchlist_preview(_now_flow(t), named)).select("ticker", "action", "links.page", "links.data")


def a22_health_sections(spark, sf):
    t = Tables(spark, sf)
    return _entries(pages.health_sections(t.audit(), t.api_keys(), t.watchlists(), t.watch_snapshots(), t.workspace_alerts(), now()))


def a24_closeout_sections(spark, sf):
    t = Tables(spark, sf)
    return _entries(pages.closeout_sections(t.audit(), _closeout(t), t.workspace_alerts(), now(), 7))


def a24_closeout_reason(spark, sf):
    return audit.closeout_verdict(_closeout(Tables(spark, sf))).select("verdict", pages.verdict_reason().alias("reason"))


def a27_sample_accessions(spark, sf):
    return _entries(pages.sample_accessions(Tables(spark, sf).chain()))


def v11_report_deltas(spark, sf):
    """Every watchlist's newest snapshot: what changed against its baseline, and its three top alerts."""
    runs = _runs(spark, sf)
    newest = writers.keep_newest(runs.table("snapshots"), ["key_id", "watchlist_id"], 1, tie="snapshot_id")
    delta = runs.table("deltas").groupBy("snapshot_id").agg(
        F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if("action_changed").alias("changed_actions"), F.count_if("score_changed").alias("changed_scores"))
    order = Window.partitionBy("watchlist_id").orderBy(F.col("severity").desc(), F.col("last_seen_at").desc(), "ticker", "action")
    top = latest_state(runs.table("alerts"), watch.ALERT_KEY).withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    top = top.groupBy("watchlist_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "action"))).alias("a"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("added", "removed", "changed_actions", "changed_scores")]
    return newest.join(delta, "snapshot_id", "left").join(top, "watchlist_id", "left").select(
        "watchlist_id", stamp("created_at"), F.col("baseline_snapshot_id").isNotNull().alias("has_baseline"), "signals", *zero,
        F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["ticker"], x["action"])), ";").alias("top_alerts"))


def k12_nested_export(spark, sf):
    """Workspaces written as nested JSON, an object each, and read back into rows."""
    t = Tables(spark, sf)
    path = shared_folder(spark, "workspaces")
    nested = writers.nested_workspaces(t.watchlists(), watch.newest_and_previous(t.watch_snapshots()), t.workspace_alerts())
    writers.write_workspaces(nested, path)
    return writers.read_workspaces(spark, path).select(
        "key_id", "watchlist_id", "name", F.array_join("tickers", ";").alias("tickers"), "latest_snapshot_id", "alert_ticker", "alert_action",
        "alert_severity", "alert_status")


QUERIES = {f.__name__: f for f in (
    v5_fund_series, v6_fund_page, p18_page_windows, v7_ticker_page, v8_preview_links, a22_health_sections, a24_closeout_sections,
    a24_closeout_reason, a27_sample_accessions, v11_report_deltas, k12_nested_export,
)}

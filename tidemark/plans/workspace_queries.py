"""Registered queries on fund and ticker pages, watchlists, audit and streaming."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import texts, values
from tidemark.operators import audit, holdings, moves, quality, watch
from tidemark.plans.driver_tables import NOW, Tables
from tidemark.plans.filing_queries import money, ratio
from tidemark.session import materialize
from tidemark.sources import writers
from tidemark.streaming import jobs


def now():
    return F.to_timestamp(F.lit(NOW))


def stamp(c, alias=None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias or c)


# -- fund and ticker pages ----------------------------------------------------------
def v5_fund_list(spark, sf):
    t = Tables(spark, sf)
    chain = t.chain()
    per = chain.groupBy("cik").agg(
        F.max("report_date").alias("latest_quarter"), F.max_by("total_value", "report_date").alias("aum"),
        F.max_by("n_positions", "report_date").alias("n_positions"), F.count(F.lit(1)).alias("n_quarters"))
    return t.funds().join(per, "cik", "left").select("cik", "label", "latest_quarter", money("aum"), "n_positions", "n_quarters")


def v6_fund_detail(spark, sf):
    """Newest filing of every fund with the one before, its moves by class and its status."""
    t = Tables(spark, sf)
    chain, funds = t.chain(flawed=True), t.flawed_funds()
    newest = holdings.current_filing(chain.select("cik", "report_date", "accession", "form", "prev_report_date", "n_positions"))
    counts = moves.move_counts(t.moves(weights=False, flawed=True), "cik", "report_date")
    gate = quality.quality_gate(chain.withColumn("total_value", F.round("total_value", 2)), funds).select("cik", "status")
    return newest.join(counts, ["cik", "report_date"]).join(gate, "cik")


def _flow(t: Tables, flawed=True):
    """Ticker flow over trusted funds; a few rows per quarter, stored once."""
    chain = t.chain(flawed).withColumn("total_value", F.round("total_value", 2))
    trusted = quality.trusted_funds(quality.quality_gate(chain, t.flawed_funds() if flawed else t.funds()))
    return materialize(watch.ticker_flow(t.moves(flawed=flawed, by_fund=True), trusted), "flow")


def _now_flow(t: Tables):
    f = _flow(t)
    return f.filter(F.col("report_date") == f.agg(F.max("report_date").alias("d")).scalar()).drop("report_date")


def _flow_columns():
    return ["ticker", "holder_count", "buyers_count", "sellers_count", "new_positions", "exits", money("total_value_usd"),
            "score", "action", F.array_join("triggers", ";").alias("triggers"), F.array_join("movement_codes", ";").alias("codes")]


def v7_ticker_flow(spark, sf):
    return _flow(Tables(spark, sf)).select("report_date", *_flow_columns())


def v8_watchlist_preview(spark, sf):
    """Preview of the tickers that customers watch, and one nobody holds."""
    t = Tables(spark, sf)
    named = t.watchlists().select(F.explode("tickers").alias("ticker")).distinct()
    out = watch.watchlist_preview(_now_flow(t), named.unionByName(spark.createDataFrame([("NONE",)], "ticker string")))
    return out.select(*_flow_columns())


def v9_discover(spark, sf):
    out = watch.discover(_now_flow(Tables(spark, sf)), 10)
    return out.select("ticker", "action", "score", "buyers_count", "new_positions")


def p16_discover_filters(spark, sf):
    out = watch.discover(_now_flow(Tables(spark, sf)), 50, mega_cap_usd=1e8, actions=["alert", "watch"], moves=["NEW"],
                         min_score=20.0, min_holders=1, min_buyers=1)
    return out.select("ticker", "action", "score", "buyers_count", "new_positions")


def p15_watchlist_filters(spark, sf):
    """Signals each saved watchlist keeps under its own filters."""
    t = Tables(spark, sf)
    return watch.watchlist_signals(t.watchlists(), _now_flow(t)).select("watchlist_id", "ticker", "action", "score")


def v10_watchlist_signals(spark, sf):
    t = Tables(spark, sf)
    kept = watch.watchlist_signals(t.watchlists(), _now_flow(t)).groupBy("watchlist_id").agg(F.count(F.lit(1)).alias("returned_count"))
    return t.watchlists().select("watchlist_id", "name", F.size("tickers").cast("long").alias("input_count")).join(
        kept, "watchlist_id", "left").withColumn("returned_count", F.coalesce("returned_count", F.lit(0)))


def a29_action_summary(spark, sf):
    t = Tables(spark, sf)
    return watch.action_counts(watch.watchlist_signals(t.watchlists(), _now_flow(t)), "watchlist_id")


def j15_snapshot_delta(spark, sf):
    """Every quarter's flow against the one before."""
    f = _flow(Tables(spark, sf)).select("report_date", "ticker", "action", "score")
    back = F.last_day(F.add_months("report_date", 3))
    out = watch.snapshot_delta(f, f.withColumn("report_date", back), "report_date")
    return out.select("report_date", "ticker", "change", "action_changed", "score_changed")


def o4_shared_tickers(spark, sf):
    """Tickers present in the first and in the last quarter."""
    f = _flow(Tables(spark, sf))
    edge = lambda agg: f.filter(F.col("report_date") == f.agg(agg("report_date").alias("d")).scalar()).select("ticker")
    return edge(F.min).intersect(edge(F.max))


def p17_fund_search(spark, sf):
    """Second page of the funds whose cik or label contains '1'."""
    f = Tables(spark, sf).funds()
    hit = F.lower(F.concat_ws(" ", "cik", "label", "manager")).contains("1")
    found = f.filter(hit)
    total = found.agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("total", total.scalar()).orderBy("label", "cik").offset(10).limit(10).select("cik", "label", "total")


def p18_bounded_lists(spark, sf):
    """First five holders of each security in each quarter, with how many there are."""
    t = Tables(spark, sf)
    snap = t.snapshots().filter("put_call = ''").withColumn("value_usd", F.round("value_usd", 2))
    order = Window.partitionBy("report_date", "cusip").orderBy(F.col("value_usd").desc(), "cik")
    first = snap.withColumn("place", F.row_number().over(order)).filter("place <= 5")
    n = snap.groupBy("report_date", "cusip").agg(F.count(F.lit(1)).alias("available"))
    return first.join(n, ["report_date", "cusip"]).select("report_date", "cusip", "cik", F.col("place").cast("long").alias("place"), "available")


def p20_moves_without_hold(spark, sf):
    m = Tables(spark, sf).moves().filter("move <> 'HOLD'")
    m = m.withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn("share_change_pct", F.round("share_change_pct", 9))
    order = Window.partitionBy("cik", "report_date").orderBy(F.greatest("curr_value", "prev_value").desc(), "cusip", "put_call")
    return m.withColumn("place", F.row_number().over(order)).filter("place <= 10").select(
        "cik", "report_date", F.col("place").cast("long").alias("place"), "cusip", "put_call", "move")


def v13_fund_print(spark, sf):
    """Top three holdings and top two moves of each class in every fund's newest quarter."""
    t = Tables(spark, sf)
    newest = t.chain().groupBy("cik").agg(F.max("report_date").alias("report_date"))
    snap = t.snapshots().withColumn("value_usd", F.round("value_usd", 2)).join(newest, ["cik", "report_date"], "left_semi")
    top = holdings.top_positions(snap, 3).select("cik", F.lit("HOLDING").alias("part"), F.col("position_rank").cast("long").alias("place"), "cusip", "put_call")
    m = t.moves().filter("move <> 'HOLD'").join(newest, ["cik", "report_date"], "left_semi")
    m = m.withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn("share_change_pct", F.round("share_change_pct", 9))
    m = moves.rank_moves(m, "cik", "report_date").filter("move_rank <= 2")
    return top.unionByName(m.select("cik", F.col("move").alias("part"), F.col("move_rank").cast("long").alias("place"), "cusip", "put_call"))


def v12_filing_alerts(spark, sf):
    """Alert text of every fund's newest quarter: counts and subject line."""
    t = Tables(spark, sf)
    chain = t.chain()
    newest = holdings.current_filing(chain.select("cik", "report_date", "accession", "form", "filing_date", "prev_report_date"))
    counts = moves.move_counts(t.moves(weights=False), "cik", "report_date")
    out = newest.join(counts, ["cik", "report_date"]).join(t.funds(), "cik")
    bits = F.array_compact(F.array(
        F.when(F.col("n_new") > 0, F.concat(F.col("n_new").cast("string"), F.lit(" new"))),
        F.when(F.col("n_exit") > 0, F.concat(F.col("n_exit").cast("string"), F.lit(" exits")))))
    head = F.when(F.size(bits) > 0, F.array_join(bits, ", ")).otherwise("filing update")
    amended = F.when(F.col("form").endswith("/A"), " (amendment)").otherwise("")
    subject = F.concat("label", F.lit(" 13F"), amended, F.lit(" ("), F.col("report_date").cast("string"), F.lit("): "), head)
    versus = F.coalesce(F.concat(F.lit(" vs "), F.col("prev_report_date").cast("string")), F.lit(" (first filing on record)"))
    line = F.concat(F.lit("Quarter "), F.col("report_date").cast("string"), versus, F.lit(" | filed "), F.col("filing_date").cast("string"), F.lit(" | "), F.col("form"))
    return out.select("cik", subject.alias("subject"), line.alias("line"), "n_new", "n_exit", "n_add", "n_trim")


def a27_live_status(spark, sf):
    """Counts, data date, quarter range and ticker coverage of the stored tables."""
    t = Tables(spark, sf)
    from tidemark.operators.consensus import coverage
    k = F.lit(1).alias("_k")
    chain = t.chain()
    total = coverage(t.snapshots(weights=False), t.funds()).filter("cik is null").select(ratio("value_share"), k)
    out = (
        t.funds().agg(F.count(F.lit(1)).alias("funds"), k)
        .join(holdings.filing_totals(t.holdings()).agg(F.count(F.lit(1)).alias("filings"), F.max("filing_date").alias("data_as_of"), k), "_k")
        .join(chain.agg(F.min("report_date").alias("first_quarter"), F.max("report_date").alias("last_quarter"), F.sum("n_positions").alias("positions"), k), "_k")
        .join(total, "_k"))
    return out.drop("_k")


# -- subscriptions -----------------------------------------------------------------------
def _subscriptions(t: Tables):
    c = t.read("customer")
    n = t.read("supplier").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    return c.withColumn("n", n.scalar()).select(
        F.concat(F.lit("u"), k.cast("string")).alias("subscription_id"), F.col("c_name").alias("user_id"),
        F.lpad((k % F.col("n")).cast("string"), 10, "0").alias("cik"), F.lit("webhook").alias("channel"),
        F.col("c_mktsegment").alias("target"), (k % 4 != 1).alias("active"), k)


def _deliveries(t: Tables, newest):
    """Some subscribers already got, were primed with, or failed to get the newest filing."""
    s = _subscriptions(t)
    status = F.when(F.col("c_custkey") % 3 == 0, "sent").when(F.col("c_custkey") % 7 == 0, "primed").when(F.col("c_custkey") % 5 == 0, "failed")
    return s.join(newest.select("cik", "accession"), "cik").select("subscription_id", "accession", status.alias("status")).filter("status is not null")


def _newest(t: Tables):
    return materialize(holdings.latest_filing_by_date(t.totals()).select("cik", "filing_date", "accession"), "newest")


def j12_pending_deliveries(spark, sf):
    t = Tables(spark, sf)
    newest = _newest(t)
    return watch.pending_deliveries(_subscriptions(t), _deliveries(t, newest), newest).select("subscription_id", "cik", "accession")


def p21_active_subscriptions(spark, sf):
    """Active subscriptions per fund, and the funds that have any."""
    s = _subscriptions(Tables(spark, sf)).filter("active")
    return s.groupBy("cik").agg(F.count(F.lit(1)).alias("subscribers"))


def st2_primed_deliveries(spark, sf):
    t = Tables(spark, sf)
    return watch.prime_subscriptions(_subscriptions(t).filter("active"), _newest(t))


def st3_delivery_outcomes(spark, sf):
    """Outcome after a log of attempts: failed ones are retried, terminal ones stay."""
    t = Tables(spark, sf)
    e = t.event_rows()
    log = e.select("key_id", F.col("tool").alias("accession"), F.col("at").alias("delivered_at"),
                   F.when(F.col("k") > 97, "sent").when(F.col("k") > 95, "primed").otherwise("failed").alias("status"))
    out = watch.latest_deliveries(log.withColumnRenamed("key_id", "subscription_id"))
    return out.select("subscription_id", "accession", "status", stamp("delivered_at"))


def st3_reactivation(spark, sf):
    """Requests of customers that exist: every second one asks again under a new id."""
    t = Tables(spark, sf)
    s = _subscriptions(t)
    key = ["subscription_id", "user_id", "cik", "channel", "target"]
    again = s.filter("c_custkey % 2 = 0").withColumn("subscription_id", F.concat(F.lit("new-"), "subscription_id")).select(*key)
    return watch.upsert_subscriptions(s.select(*key, "active"), again).select("subscription_id", "user_id", "active")


# -- audit ---------------------------------------------------------------------------------
def a18_status_rollup(spark, sf):
    out = audit.status_rollup(Tables(spark, sf).audit(), "key_id")
    return out.withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss"))


def a19_route_rollup(spark, sf):
    out = audit.route_rollup(Tables(spark, sf).audit(), 3, "key_id")
    return out.select("key_id", "route", "method", "count", "errors", F.col("route_rank").cast("long").alias("route_rank"))


def a20_usage_report(spark, sf):
    t = Tables(spark, sf)
    return audit.usage_report(t.audit(), t.api_keys(), now()).select(
        "key_id", "minute_used", "day_used", "month_used", "minute_remaining", "minute_used_pct", "day_remaining", "day_used_pct")


def j14_keys_and_usage(spark, sf):
    """Top 25 keys by use today, then this minute."""
    t = Tables(spark, sf)
    u = audit.usage_report(t.audit(), t.api_keys(), now())
    return u.orderBy(F.col("day_used").desc(), F.col("minute_used").desc(), F.col("created_at").desc()).limit(25).select(
        "key_id", "label", "tier", "minute_used", "day_used")


def f17_quota(spark, sf):
    t = Tables(spark, sf)
    day = t.audit().groupBy("key_id", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    k = t.api_keys().select("key_id", "rate_per_day")
    return day.join(k, "key_id").select(
        "key_id", "day", "used", values.quota_remaining(F.col("used"), F.col("rate_per_day")).alias("remaining"),
        values.quota_used_pct(F.col("used"), F.col("rate_per_day")).alias("used_pct"))


def a21_key_lifecycle(spark, sf):
    return audit.key_lifecycle(Tables(spark, sf).api_keys(), now()).select(
        "key_id", "active", "revoked", "expired", "rotation_due", "rotation_due_soon")


def a22_health_report(spark, sf):
    t = Tables(spark, sf)
    out = audit.health_report(t.audit(), t.api_keys(), now())
    return out.withColumn("latest_at", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss")).withColumn("warnings", F.array_join("warnings", "; "))


def _closeout(t: Tables):
    return audit.closeout_keys(t.audit(), t.api_keys(), t.watchlists(), t.watch_snapshots(), t.workspace_alerts(), now(), 7)


def a24_closeout_keys(spark, sf):
    return _closeout(Tables(spark, sf)).select(
        "key_id", "requests", "ok", "errors", "server_errors", "watchlists", "watchlists_created", "snapshots", "alerts",
        "open_alerts", "new_alerts", "revoked", "expired", "rotation_due")


def a24_closeout_verdict(spark, sf):
    return audit.closeout_verdict(_closeout(Tables(spark, sf)))


def a33_audit_freshness(spark, sf):
    out = audit.audit_freshness(Tables(spark, sf).audit(), F.to_timestamp(F.lit("2024-02-02 00:00:00")), 24)
    return out.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def st6_audit_retention(spark, sf):
    return audit.prune_counts(Tables(spark, sf).audit(), now(), 10)


def a34_watchlists_per_key(spark, sf):
    return audit.keys_over_limit(Tables(spark, sf).watchlists(), 10)


def l8_recent_errors(spark, sf):
    a = Tables(spark, sf).audit().filter("status >= 400")
    return a.orderBy(F.col("at").desc(), F.col("id").desc()).limit(50).select("id", "key_id", "method", "route", "status")


def l11_keys_newest_first(spark, sf):
    t = Tables(spark, sf)
    order = Window.partitionBy("key_id").orderBy(F.col("updated_at").desc(), "name")
    w = t.watchlists().withColumn("place", F.row_number().over(order)).filter("place = 1").select("key_id", F.col("name").alias("last_watchlist"))
    return t.api_keys().join(w, "key_id", "left").orderBy(F.col("created_at").desc(), "key_id").select("key_id", "label", "last_watchlist")


def a23_workspace_totals(spark, sf):
    t = Tables(spark, sf)
    a = t.workspace_alerts().groupBy("key_id").agg(
        F.count(F.lit(1)).alias("alerts"), *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "acknowledged", "dismissed")])
    s = t.watch_snapshots().groupBy("key_id").agg(F.count(F.lit(1)).alias("signal_snapshots"), F.max("created_at").alias("latest"))
    w = t.watchlists().groupBy("key_id").agg(F.count(F.lit(1)).alias("watchlists"))
    return w.join(s, "key_id", "left").join(a, "key_id", "left").select(
        "key_id", "watchlists", "signal_snapshots", stamp("latest", "latest_snapshot_at"), "alerts", "open", "acknowledged", "dismissed")


def _schedule(t: Tables):
    return watch.watchlist_schedule(t.watchlists(), t.api_keys(), t.watch_snapshots(), now())


def j13_watchlist_schedule(spark, sf):
    return _schedule(Tables(spark, sf)).select("watchlist_id", "key_label", stamp("latest_snapshot_at"), "due")


def st10_due_watchlists(spark, sf):
    return watch.due_watchlists(_schedule(Tables(spark, sf))).select("watchlist_id", "frequency")


def a25_automation_demand(spark, sf):
    return watch.schedule_summary(_schedule(Tables(spark, sf))).withColumn(
        "latest_snapshot_at", F.date_format("latest_snapshot_at", "yyyy-MM-dd HH:mm:ss"))


def l7_alerts_by_severity(spark, sf):
    out = watch.list_alerts(Tables(spark, sf).workspace_alerts(), "open", 3)
    return out.select("key_id", "alert_id", "ticker", "severity", F.col("alert_rank").cast("long").alias("alert_rank"))


def w14_keep_newest(spark, sf):
    s = Tables(spark, sf).watch_snapshots()
    return writers.keep_newest(s, ["key_id", "watchlist_id"], 2, tie="snapshot_id").select("watchlist_id", "snapshot_id")


def w18_newest_snapshot(spark, sf):
    return watch.newest_and_previous(Tables(spark, sf).watch_snapshots()).select("watchlist_id", "snapshot_id", "baseline_snapshot_id")


def v11_workspace_report(spark, sf):
    """Newest snapshot, baseline and the three top alerts of every watchlist."""
    t = Tables(spark, sf)
    latest = watch.newest_and_previous(t.watch_snapshots()).drop("key_id")
    top = watch.list_alerts(t.workspace_alerts(), None, 3, "watchlist_id").groupBy("watchlist_id").agg(
        F.array_sort(F.collect_list(F.struct("alert_rank", "ticker"))).alias("a"))
    return t.watchlists().join(latest, "watchlist_id", "left").join(top, "watchlist_id", "left").select(
        "watchlist_id", "name", "snapshot_id", "baseline_snapshot_id",
        F.array_join(F.transform(F.col("a"), lambda x: x["ticker"]), ";").alias("top_alerts"))


def k12_workspace_export(spark, sf):
    t = Tables(spark, sf)
    return writers.workspace_export(t.watchlists(), watch.newest_and_previous(t.watch_snapshots()), t.workspace_alerts())


def f26_alert_severity(spark, sf):
    t = Tables(spark, sf)
    s = watch.watchlist_signals(t.watchlists(), _now_flow(t))
    return s.groupBy("action", texts.alert_severity(F.col("action")).cast("long").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def st9_alert_status_fold(spark, sf):
    """Status of alerts after events: users act as alerts, event kinds as status changes."""
    e = Tables(spark, sf).event_rows()
    status = F.when(F.col("k") < 10, "open").when(F.col("k") % 2 == 0, "acknowledged").otherwise("dismissed")
    out = watch.fold_alert_status(e.select(F.col("key_id").alias("alert_id"), status.alias("status"), "at"))
    return out.select("alert_id", "status", stamp("acknowledged_at"), stamp("dismissed_at"))


# -- telemetry ---------------------------------------------------------------------------
def a26_telemetry_windows(spark, sf):
    return audit.telemetry_windows(audit.daily_telemetry(Tables(spark, sf).telemetry()), F.lit("2024-01-31").cast("date"))


def a26_telemetry_by_tool(spark, sf):
    d = audit.daily_telemetry(Tables(spark, sf).telemetry()).filter("tool is not null")
    return audit.telemetry_summary(d, "tool").select("tool", "tool_calls", "tool_successes", "tool_errors", "tool_success_rate",
                                                     "average_tool_latency_ms", "max_tool_latency_ms")


def l9_clients_by_use(spark, sf):
    d = audit.daily_telemetry(Tables(spark, sf).telemetry()).filter("client is not null")
    return audit.telemetry_summary(d, "client").select("client", "initializations").orderBy(F.col("initializations").desc(), "client")


# -- streaming ------------------------------------------------------------------------------
def _event_stream(t: Tables):
    """The events file as a stream source, with the same columns as the batch table."""
    schema = t.read("events").schema
    live = Tables(t.spark, t.sf_dir)
    live.read = lambda name: t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet")
    return live


def st4_rate_counts(spark, sf):
    """Requests per key and day from a stream, compared with the daily limit."""
    t = Tables(spark, sf)
    log = jobs.updates_table(jobs.rate_counts(_event_stream(t).audit(), "1 day"), "rates")
    out = jobs.over_limit(jobs.latest_state(log, ["key_id", "window_start"]), t.api_keys(), "rate_per_day")
    return out.select("key_id", F.to_date("window_start").alias("day"), "count", "over_limit")


def st4_minute_counts(spark, sf):
    log = jobs.updates_table(jobs.rate_counts(_event_stream(Tables(spark, sf)).audit(), "1 minute"), "minutes")
    return jobs.latest_state(log, ["key_id", "window_start"]).groupBy("count").agg(F.count(F.lit(1)).alias("windows"))


def st7_daily_counters(spark, sf):
    log = jobs.updates_table(jobs.daily_counters(_event_stream(Tables(spark, sf)).telemetry()), "daily")
    state = jobs.latest_state(log, ["day", "tool"])
    return jobs.retained_days(state, F.lit("2024-01-30").cast("date"), 14).select("day", "tool", "tool_calls", "tool_successes", ratio("tool_max_ms"))


def st13_audit_appends(spark, sf):
    log = jobs.updates_table(jobs.audit_appends(_event_stream(Tables(spark, sf)).audit()), "audit", "append")
    return log.groupBy("key_id", "status").agg(F.count(F.lit(1)).alias("n"))


def st5_client_windows(spark, sf):
    """Fixed windows from each client's first request: six hours, three requests allowed."""
    own = spark.newSession()  # the state's setting holds for this query only
    own.conf.set(*jobs.ROCKSDB)
    e = _event_stream(Tables(own, sf)).audit().select("key_id", F.unix_millis("at").alias("at_ms"))
    log = jobs.updates_table(jobs.client_windows(e, limit=3, window_ms=6 * 3600 * 1000), "clients")
    return log.groupBy("key_id").agg(F.sum("requests").alias("requests"), F.sum("refused").alias("refused"))


def _as_stream(df, name):
    """A table written to the shared folder and read back as a stream."""
    path = materialize_path(df, name)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def materialize_path(df, name):
    from tidemark.session import shared_folder
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def st14_sliding_windows(spark, sf):
    t = Tables(spark, sf)
    trades = t.trades().select("ticker", "transaction_code", "acquired_disposed", "shares", "price_per_share",
                               F.to_timestamp("transaction_date").alias("traded_at"))
    log = jobs.updates_table(jobs.trailing_buyers(_as_stream(trades, "trades")), "sliding")
    return jobs.latest_state(log, ["ticker", "window_end"]).select("ticker", "window_end", "buys", "buy_usd")


def st1_filing_alert_stream(spark, sf):
    """Filings as a stream; every active subscription gets its fund's newest filing once."""
    t = Tables(spark, sf)
    filings = holdings.filing_totals(t.holdings()).select("cik", "filing_date", "accession")
    out = jobs.filing_alerts(_as_stream(filings, "filings"), materialize(_subscriptions(t), "subscriptions"))
    return out.select("subscription_id", "accession", "status")


def st12_late_amendments(spark, sf):
    """Filings as a stream; the resolved filing of a touched quarter is decided again."""
    t = Tables(spark, sf)
    filings = holdings.filing_totals(t.holdings())
    schema = "accession string, cik string, report_date date, form string, filing_date date, total_value double, n_positions bigint"
    out = jobs.resolved_stream(_as_stream(filings, "filings"), holdings.resolve_filings, schema)
    return out.select("cik", "report_date", "accession")


def st8_alert_upserts(spark, sf):
    """Alert candidates of all quarters as a stream into the alert table."""
    t = Tables(spark, sf)
    f = _flow(t)
    signals = f.select(F.lit("k").alias("key_id"), F.lit("w").alias("watchlist_id"), "ticker", "action", "score", "report_date")
    batch = watch.alert_candidates(signals, F.col("report_date").cast("string"), F.to_timestamp("report_date"))
    out = jobs.alert_stream(_as_stream(batch, "candidates"))
    return out.select("ticker", "action", "status", "snapshot_id", F.to_date("first_seen_at").alias("first_seen"),
                      F.to_date("last_seen_at").alias("last_seen"), F.col("severity").cast("long").alias("severity"))


def st11_snapshot_run(spark, sf):
    """One automated run over the due watchlists: a snapshot row each."""
    t = Tables(spark, sf)
    out = jobs.snapshot_run(_schedule(t), _now_flow(t), None, now())
    return out.select("watchlist_id", "key_id", "alerts", "watch", "monitor", "blocked")


QUERIES = {f.__name__: f for f in (
    v5_fund_list, v6_fund_detail, v7_ticker_flow, v8_watchlist_preview, v9_discover, p16_discover_filters,
    p15_watchlist_filters, v10_watchlist_signals, a29_action_summary, j15_snapshot_delta, o4_shared_tickers,
    p17_fund_search, p18_bounded_lists, p20_moves_without_hold, v13_fund_print, v12_filing_alerts, a27_live_status,
    j12_pending_deliveries, p21_active_subscriptions, st2_primed_deliveries, st3_delivery_outcomes, st3_reactivation,
    a18_status_rollup, a19_route_rollup, a20_usage_report, j14_keys_and_usage, f17_quota, a21_key_lifecycle,
    a22_health_report, a24_closeout_keys, a24_closeout_verdict, a33_audit_freshness, st6_audit_retention,
    a34_watchlists_per_key, l8_recent_errors, l11_keys_newest_first, a23_workspace_totals, j13_watchlist_schedule,
    st10_due_watchlists, a25_automation_demand, l7_alerts_by_severity, w14_keep_newest, w18_newest_snapshot,
    v11_workspace_report, k12_workspace_export, f26_alert_severity, st9_alert_status_fold, a26_telemetry_windows,
    a26_telemetry_by_tool, l9_clients_by_use, st4_rate_counts, st4_minute_counts, st7_daily_counters,
    st13_audit_appends, st5_client_windows, st14_sliding_windows, st1_filing_alert_stream, st12_late_amendments,
    st8_alert_upserts, st11_snapshot_run,
)}

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.operators import audit, holdings, watch
from tidemark.session import shared_folder
from tidemark.streaming import jobs

D = dt.date.fromisoformat
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def as_stream(df, batches, key, path=None):
    """Files per batch number, read one file per trigger in that order."""
    spark = df.sparkSession
    path = path or shared_folder(spark, "src")
    for b in batches:
        df.filter(F.col(key) == b).drop(key).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop(key).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_filing_alerts_once_per_subscription_and_failed_ones_again(spark):
    filings = spark.createDataFrame([("1", D("2024-02-14"), "a", 0), ("1", D("2024-05-15"), "b", 1), ("2", D("2024-05-15"), "c", 1)],
                                    "cik string, filing_date date, accession string, b int")
    subs = spark.createDataFrame([("s1", "1", True), ("s2", "1", False), ("s3", "2", True)], "subscription_id string, cik string, active boolean")
    sent = []

    def send(pending):
        rows = [(r.subscription_id, r.accession) for r in pending.select("subscription_id", "accession").collect()]
        sent.extend(rows)
        return pending.withColumn("status", F.when((F.col("accession") == "a"), "failed").otherwise("sent"))

    out = jobs.filing_alerts(as_stream(filings, (0, 1), "b"), subs, send)
    assert {(r.subscription_id, r.accession, r.status) for r in out.collect()} == {("s1", "a", "failed"), ("s1", "b", "sent"), ("s3", "c", "sent")}
    assert sorted(sent) == [("s1", "a"), ("s1", "b"), ("s3", "c")]


def test_a_later_run_goes_on_and_sends_nothing_twice(spark, tmp_path):
    source, path = str(tmp_path / "src"), str(tmp_path / "alerts")
    filings = spark.createDataFrame([("1", D("2024-02-14"), "a", 0), ("2", D("2024-02-14"), "x", 0), ("1", D("2024-05-15"), "b", 1), ("3", D("2024-05-15"), "y", 2)],
                                    "cik string, filing_date date, accession string, b int")
    subs = spark.createDataFrame([("s1", "1", True), ("s2", "2", True), ("s3", "3", True)], "subscription_id string, cik string, active boolean")
    sent, fails = [], {"x": 2}

    def send(pending):
        rows = sorted((r.subscription_id, r.accession) for r in pending.select("subscription_id", "accession").collect())
        sent.append(rows)
        down = [a for _, a in rows if fails.get(a, 0) > 0]
        for a in down:
            fails[a] -= 1
        return pending.withColumn("status", F.when(F.col("accession").isin(*down, ""), "failed").otherwise("sent"))

    for b in range(3):  # each run is a new query on the same folders
        out = jobs.filing_alerts(as_stream(filings, (b,), "b", source), subs, send, path)
    once = [list(x) for k, x in enumerate(sent) if x != (sent[k - 1] if k else None) or k == 0]
    assert {(r.subscription_id, r.accession, r.status) for r in out.collect()} == {("s1", "a", "sent"), ("s1", "b", "sent"), ("s2", "x", "sent"), ("s3", "y", "sent")}
    assert once[0] == [("s1", "a"), ("s2", "x")] and ("s2", "x") in once[1] and ("s1", "a") not in sum(once[1:], [])
    again = jobs.filing_alerts(as_stream(filings, (), "b", source), subs, send, path)
    assert again.count() == 4


def test_a_late_amendment_is_taken_up_by_a_later_run(spark, tmp_path):
    schema = "accession string, cik string, report_date date, form string, filing_date date, total_value double, n_positions bigint"
    rows = [("o", "1", D("2024-03-31"), "13F-HR", D("2024-05-15"), 1.0, 4, 0), ("n", "1", D("2024-06-30"), "13F-HR", D("2024-08-15"), 1.0, 4, 0), ("f", "1", D("2024-03-31"), "13F-HR/A", D("2025-05-15"), 1.0, 4, 1)]
    df = spark.createDataFrame(rows, schema + ", b int")
    for b, want in ((0, "o"), (1, "f")):
        out = jobs.resolved_stream(as_stream(df, (b,), "b", str(tmp_path / "src")), holdings.resolve_filings, schema, str(tmp_path / "out"))
        assert {r.report_date: r.accession for r in out.collect()} == {D("2024-03-31"): want, D("2024-06-30"): "n"}


def test_pending_selection(spark):
    subs = spark.createDataFrame([("s1", "1", True), ("s2", "1", True), ("s3", "1", True)], "subscription_id string, cik string, active boolean")
    done = spark.createDataFrame([("s1", "a", "primed"), ("s2", "a", "failed")], "subscription_id string, accession string, status string")
    newest = spark.createDataFrame([("1", "a")], "cik string, accession string")
    assert {r.subscription_id for r in watch.pending_deliveries(subs, done, newest).collect()} == {"s2", "s3"}


def test_late_amendment_changes_only_its_quarter(spark):
    schema = "accession string, cik string, report_date date, form string, filing_date date, total_value double, n_positions bigint"
    rows = [("o", "1", D("2024-03-31"), "13F-HR", D("2024-05-15"), 1.0, 4, 0), ("n", "1", D("2024-06-30"), "13F-HR", D("2024-08-15"), 1.0, 4, 0),
            ("p", "1", D("2024-03-31"), "13F-HR/A", D("2024-09-15"), 1.0, 1, 1), ("f", "1", D("2024-03-31"), "13F-HR/A", D("2025-05-15"), 1.0, 4, 2)]
    df = spark.createDataFrame(rows, schema + ", b int")
    def final(n):
        out = jobs.resolved_stream(as_stream(df, range(n), "b"), holdings.resolve_filings, schema)
        return {r.report_date: r.accession for r in out.collect()}
    assert final(2) == {D("2024-03-31"): "o", D("2024-06-30"): "n"}
    assert final(3) == {D("2024-03-31"): "f", D("2024-06-30"): "n"}


def test_alert_upsert_keeps_first_seen_and_status(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    c = spark.createDataFrame([("k", "w", "AAPL", "alert", 3, 70.0, "s1", at(0), 0), ("k", "w", "AAPL", "alert", 3, 80.0, "s2", at(5), 1),
                               ("k", "w", "AAPL", "watch", 2, 40.0, "s2", at(5), 1)],
                              "key_id string, watchlist_id string, ticker string, action string, severity int, reason_score double, snapshot_id string, seen_at timestamp, b int")
    out = {r.action: r for r in jobs.alert_stream(as_stream(c, (0, 1), "b")).collect()}
    a = out["alert"]
    assert (a.first_seen_at, a.last_seen_at, a.snapshot_id, a.reason_score, a.status) == (at(0), at(5), "s2", 80.0, "open")
    assert out["watch"].first_seen_at == at(5)


def test_stream_counts_equal_batch_counts(spark):
    rows = [(i, f"k{i % 3}", T0 + dt.timedelta(seconds=20 * i), 200, "GET", "/r", i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, key_id string, at timestamp, status int, method string, route string, b int")
    log = jobs.updates_table(jobs.rate_counts(as_stream(df, range(4), "b")), "t")
    got = {(r.key_id, r.window_start): r["count"] for r in jobs.latest_state(log, ["key_id", "window_start"]).collect()}
    want = {(r.key_id, r.minute): r["count"] for r in audit.usage_buckets(df).collect()}
    assert got == want
    twice = df.unionByName(df.withColumn("b", F.lit(9)))
    appended = jobs.updates_table(jobs.audit_appends(as_stream(twice, (0, 1, 2, 3, 9), "b")), "a", "append")
    assert appended.count() == 200


def test_client_windows_equal_a_plain_loop(spark):
    rows = [("a", t) for t in (0, 10, 20, 30, 1000, 1005, 1990, 2001)] + [("b", 5)]
    own = spark.newSession()
    own.conf.set(*jobs.ROCKSDB)
    df = own.createDataFrame(rows[::-1], "key_id string, at_ms bigint").withColumn("b", F.lit(0))  # not in order of time
    out = jobs.updates_table(jobs.client_windows(as_stream(df, (0,), "b"), limit=2, window_ms=1000), "c")
    start, used, refused = None, 0, 0
    for k, t in rows:
        if k == "a":
            if start is None or t - start >= 1000:
                start, used = t, 0
            used += 1
            refused += used > 2
    got = {r.key_id: (r.requests, r.refused) for r in out.collect()}
    assert got == {"a": (8, refused), "b": (1, 0)}


def test_due_watchlists(spark):
    now = F.lit(T0)
    ago = lambda h: T0 - dt.timedelta(hours=h)
    w = spark.createDataFrame([(i, "k", e, f, T0) for i, e, f in (("d1", True, "daily"), ("d2", True, "daily"), ("w1", True, "weekly"), ("w2", True, "weekly"),
                               ("off", False, "daily"), ("m", True, "manual"), ("new", True, "daily"))],
                              "watchlist_id string, key_id string, enabled boolean, frequency string, updated_at timestamp")
    s = spark.createDataFrame([(i, "k", ago(h)) for i, h in (("d1", 24), ("d2", 2), ("w1", 8 * 24), ("w2", 48))], "watchlist_id string, key_id string, created_at timestamp")
    k = spark.createDataFrame([("k", "L", None, None)], "key_id string, label string, revoked_at timestamp, expires_at timestamp")
    sch = watch.watchlist_schedule(w, k, s, now)
    assert [r.watchlist_id for r in watch.due_watchlists(sch).collect()] == ["new", "w1", "d1"]
    assert watch.schedule_summary(sch).collect()[0].invalid_policy == 1


def test_status_fold_reopen_clears_stamps(spark):
    rows = [("a", "acknowledged", 0), ("a", "open", 1), ("a", "dismissed", 2), ("b", "acknowledged", 0), ("b", "dismissed", 1), ("c", "open", 0)]
    e = spark.createDataFrame([(i, s, T0 + dt.timedelta(hours=h)) for i, s, h in rows], "alert_id string, status string, at timestamp")
    got = {r.alert_id: (r.status, r.acknowledged_at is not None, r.dismissed_at is not None) for r in watch.fold_alert_status(e).collect()}
    assert got == {"a": ("dismissed", False, True), "b": ("dismissed", True, True), "c": ("open", False, False)}


def test_snapshot_delta_first_and_second_run(spark):
    cur = spark.createDataFrame([("aapl ", "alert", 50.0), ("KO", "watch", 31.0)], "ticker string, action string, score double")
    first = watch.snapshot_delta(cur, cur.limit(0)).collect()
    assert {(r.ticker, r.change) for r in first} == {("AAPL", "added"), ("KO", "added")}
    assert all(r.change == "kept" and not r.action_changed and not r.score_changed for r in watch.snapshot_delta(cur, cur).collect())
    prev = spark.createDataFrame([("AAPL", "watch", 49.95), ("GE", "watch", 31.0)], "ticker string, action string, score double")
    got = {r.ticker: (r.change, r.action_changed, r.score_changed) for r in watch.snapshot_delta(cur, prev).collect()}
    assert got == {"AAPL": ("kept", True, False), "KO": ("added", False, False), "GE": ("removed", False, False)}


def test_telemetry_windows(spark):
    old = T0 - dt.timedelta(days=31)
    rows = [(T0, "tool", 0, "t", None, True, 10.0), (T0, "tool", 0, "t", None, True, 90000.0), (T0, "tool", 0, "t", None, False, 5.0),
            (old, "tool", 0, "t", None, True, 5.0), (T0, "initialize", 0, None, "claude-x", None, None), (T0, "http", 503, None, None, None, None)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, status int, tool string, client string, success boolean, duration_ms double")
    w = {r.span: r for r in audit.telemetry_windows(audit.daily_telemetry(df), F.lit("2024-01-01").cast("date")).collect()}
    assert (w["30d"].tool_calls, w["lifetime"].tool_calls, w["7d"].max_tool_latency_ms, w["7d"].http_5xx) == (3, 4, 60000, 1)
    assert w["7d"].tool_success_rate == 0.6667 and w["7d"].initializations == 1


def test_flow_of_three_funds(spark):
    rows = [("B", "ADD", 130.0, 0.2), ("P", "NEW", 35.0, 0.1), ("G", "EXIT", 0.0, 0.0)]
    m = spark.createDataFrame([(c, D("2026-03-31"), "037833100", "", "AAPL", k, v, w) for c, k, v, w in rows],
                              "cik string, report_date date, cusip string, put_call string, ticker string, move string, curr_value double, curr_weight double")
    f = watch.ticker_flow(m).collect()[0]
    assert (f.holder_count, f.buyers_count, f.sellers_count, f.new_positions, f.exits) == (2, 2, 1, 1, 1)
    assert f.score > 30 and f.action == "alert" and "new_position" in f.triggers
    trusted = spark.createDataFrame([("B",)], "cik string")
    assert watch.ticker_flow(m, trusted).collect()[0].holder_count == 1

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.session import shared_folder
from tidemark.streaming.automation import SnapshotRuns, read_filters

T0 = dt.datetime(2024, 1, 1, 12)
FLOW = ("ticker string, holder_count bigint, buyers_count bigint, sellers_count bigint, new_positions bigint, exits bigint, total_value_usd double, "
        "score double, action string, triggers array<string>, movement_codes array<string>")


def flow(spark, day):
    rows = [("AAPL", 3, 2, 0, 1, 0, 5e6, 60.0, "alert", ["new_position"], ["ADD", "NEW"]), ("KO", 1, 1, 0, 0, 0, 1e6, 35.0 + day, "watch", [], ["ADD"])]
    if day:
        rows[0] = ("AAPL", 2, 0, 1, 0, 1, 4e6, 10.0, "monitor", [], ["EXIT"])
    return spark.createDataFrame(rows, FLOW)


def setting(spark, path):
    lists = [("k", "w1", "Both", ["aapl ", "KO", "NONE"], None, "daily"), ("k", "w2", "Filtered", ["AAPL", "KO"], '{"action": ["alert"], "min_score": "30", "max_13f_value_usd": null}', "weekly"),
             ("k", "bad1", "Cut off", ["KO"], '{"action": ["al', "daily"), ("k", "bad2", "Word", ["KO"], '{"min_holders": "many"}', "daily"), ("k", "bad3", "List", ["KO"], "[1]", "daily"),
             ("k", "empty", "No tickers", [], "{}", "daily"), ("gone", "w9", "Revoked key", ["KO"], "{}", "daily")]
    watchlists = spark.createDataFrame([(*x, True, T0) for x in lists] + [("k", "off", "Off", ["KO"], "{}", "daily", False, T0)],
                                       "key_id string, watchlist_id string, name string, tickers array<string>, filters string, frequency string, enabled boolean, updated_at timestamp")
    keys = spark.createDataFrame([("k", "Key", None, None), ("gone", "Old", T0 - dt.timedelta(days=9), None)], "key_id string, label string, revoked_at timestamp, expires_at timestamp")
    return SnapshotRuns(spark, path, watchlists, keys, lambda now: flow(spark, 0).where(F.to_date(now) == T0.date()).unionByName(flow(spark, 1).where(F.to_date(now) > T0.date())))


def contents(runs):
    return {name: sorted(map(str, runs.table(name).drop("batch_id").collect())) for name in ("snapshots", "signals", "alerts", "deltas", "activity", "outcomes", "runs")}


def ticks(spark, path, *at):
    for t in at:
        spark.createDataFrame([(t,)], "run_at timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("run_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_broken_watchlists_are_rows_and_the_others_go_on(spark):
    runs, source = setting(spark, shared_folder(spark, "runs")), shared_folder(spark, "ticks")
    runs.follow(ticks(spark, source, T0))
    outcomes = {r.watchlist_id: (r.signals, r.error) for r in runs.table("outcomes").collect()}
    assert outcomes == {"w1": (3, None), "w2": (1, None), "bad1": (None, "filters are not JSON"), "bad2": (None, "min_holders is not int"),
                        "bad3": (None, "filters are not an object"), "empty": (None, "no tickers")}
    run = runs.table("runs").first()
    assert (run.due, run.processed, run.failed, run.ok) == (6, 2, 4, False)
    snap = {r.watchlist_id: r for r in runs.table("snapshots").collect()}
    assert (snap["w1"].alerts, snap["w1"].watch, snap["w1"].blocked, snap["w1"].input_count, snap["w1"].baseline_snapshot_id) == (1, 1, 1, 3, None)
    events = {r.entity_id: (r.event_type, json.loads(r.detail)) for r in runs.table("activity").collect()}
    assert events["bad1"] == ("signals.snapshot.automation_failed", {"error": "filters are not JSON"})
    assert events["w1"][1]["alerts"] == {"candidates": 2, "open": 3, "acknowledged": 0, "dismissed": 0} and events["w1"][1]["delta"]["added"] == 3

    # Two hours later only what has no snapshot is due; a day later daily lists are, with their difference.
    runs.follow(ticks(spark, source, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(days=1)))
    assert [r.due for r in runs.table("runs").orderBy("run_at").collect()] == [6, 4, 5]
    later = {r.ticker: r for r in runs.table("deltas").where("batch_id = 2").collect()}
    assert {t: (r.change, r.action_changed, r.score_changed) for t, r in later.items()} == {"AAPL": ("kept", True, True), "KO": ("kept", False, True)}
    ko = runs.table("alerts").where("ticker = 'KO'").orderBy(F.desc("batch_id")).first()
    assert (ko.first_seen_at, ko.last_seen_at, ko.reason_score) == (T0, T0 + dt.timedelta(days=1), 36.0)
    assert runs.kept_snapshots(1).where("watchlist_id = 'w1'").count() == 1 and runs.kept_snapshots().where("watchlist_id = 'w1'").count() == 2


def test_a_batch_that_runs_again_changes_nothing_and_half_a_batch_is_not_seen(spark, monkeypatch):
    runs = setting(spark, shared_folder(spark, "runs"))
    first, second = (spark.createDataFrame([(t,)], "run_at timestamp") for t in (T0, T0 + dt.timedelta(days=8)))
    runs.step(first, 0)
    runs.step(second, 1)
    before = contents(runs)
    runs.step(second, 1)
    assert contents(runs) == before

    def stop(*_):
        raise RuntimeError("executor lost")

    third = spark.createDataFrame([(T0 + dt.timedelta(days=20),)], "run_at timestamp")
    with monkeypatch.context() as m:
        m.setattr(SnapshotRuns, "activity", stop)
        try:
            runs.step(third, 2)
        except RuntimeError:
            pass
    assert contents(runs) == before  # snapshots, signals and alerts of batch 2 are written, but not committed
    runs.step(third, 2)
    assert runs.table("runs").count() == 3 and len(contents(runs)["snapshots"]) == len(before["snapshots"]) + 2


def test_no_due_watchlists_and_an_empty_batch(spark):
    runs = setting(spark, shared_folder(spark, "runs"))
    runs.step(spark.createDataFrame([], "run_at timestamp"), 0)
    assert runs.table("runs").count() == 0
    runs.watchlists = runs.watchlists.limit(0)
    runs.step(spark.createDataFrame([(T0,)], "run_at timestamp"), 1)
    assert tuple(runs.table("runs").drop("batch_id").first()) == (T0, 0, 0, 0, True)


def test_saved_filters_of_every_kind_are_read(spark):
    given = ['{"action": [], "move": ["NEW"], "min_score": 1, "min_holders": 2, "min_buyers": "3"}', "", None, "{}", '{"action": "alert"}', '{"min_score": [1]}', "null"]
    rows = spark.createDataFrame([(i, g, ["A"]) for i, g in enumerate(given)], "i int, filters string, tickers array<string>")
    got = [tuple(r) for r in read_filters(rows).orderBy("i").select("f_actions", "f_moves", "min_score", "min_holders", "min_buyers", "max_13f_value_usd", "error").collect()]
    assert got[0] == ([], ["NEW"], 1.0, 2, 3, None, None)
    assert got[1] == got[2] == got[3] == (None,) * 7
    assert [g[-1] for g in got[4:]] == ["action is not array<string>", "min_score is not double", "filters are not an object"]

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import pages
from tidemark.operators.watch import with_links
from tidemark.session import shared_folder
from tidemark.sources import writers
from tidemark.sources.holdings_store import HoldingsStore
from tidemark.sources.price_source import PUSHDOWN, PriceReader, PriceSource
from tidemark.streaming import jobs, retention
from test_watch_streams import as_stream

D = dt.date.fromisoformat
T0 = dt.datetime(2024, 1, 1, 12)
POSITION = ("accession string, cik string, report_date date, form string, filing_date date, cusip string, put_call string, issuer string, "
            "title_of_class string, ticker string, value_usd double, shares double")


def positions(spark, quarters):
    rows = [(f"{c}-{q}", c, D(q), "13F-HR", D(q) + dt.timedelta(days=45), f"cusip{i}", "", "I", "T", "TK", 10.0 * i + 1, 1.0 * i + 1)
            for c in ("1", "2") for q in quarters for i in range(3)]
    return spark.createDataFrame(rows, POSITION)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_only_folders_of_chosen_quarters_are_read(spark, tmp_path):
    store = HoldingsStore(spark, str(tmp_path / "store"))
    store.save(positions(spark, ["2023-12-31", "2024-03-31", "2024-06-30", "2024-09-30"]))
    some = store.positions(F.lit("2024-03-31").cast("date"), F.lit("2024-06-30").cast("date"))
    assert some.count() == 12 and "PartitionFilters: [isnotnull(report_date" in plan_of(some)
    assert {f.split("report_date=")[1][:10] for f in some.inputFiles()} >= {"2024-03-31"}

    chosen = store.newest(1).filter("recency = 1").select("report_date", "accession")
    read = store.of(chosen)
    assert "dynamicpruning" in plan_of(read).lower()
    assert sorted({r.accession for r in read.collect()}) == ["1-2024-09-30", "2-2024-09-30"]

    # A later batch replaces its quarters and leaves the others alone.
    late = positions(spark, ["2024-09-30"]).filter("cik = '1'").withColumn("value_usd", F.lit(5.0))
    store.save(late)
    assert {(r.cik, r.total_value) for r in store.filings().filter("report_date = DATE '2024-09-30'").collect()} == {("1", 15.0)}
    assert store.filings().count() == 7


def prices(spark, path):
    rows = [(t, D("2024-01-01") + dt.timedelta(days=i), float(i)) for t in ("AA", "BB", "CC", "DD") for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    df.write.parquet(path)
    return df


def test_price_source_equals_its_table_and_takes_filters(spark, tmp_path):
    path = str(tmp_path / "prices")
    table = prices(spark, path)
    own = spark.newSession()
    own.conf.set(*PUSHDOWN)
    own.dataSource.register(PriceSource)
    source = own.read.format("tidemark_prices").option("path", path).option("splits", "BB,DD").load()
    assert source.select(F.spark_partition_id()).distinct().count() == 3
    assert sorted(map(tuple, source.collect())) == sorted(map(tuple, table.collect()))
    few = source.filter((F.col("date") >= F.lit("2024-02-01").cast("date")) & (F.col("ticker") == "CC") & (F.col("adj_close") > 40))
    assert sorted(r.adj_close for r in few.collect()) == [float(i) for i in range(41, 60)]
    assert few.select(F.spark_partition_id()).distinct().count() == 1  # only the range that holds the ticker
    plain = own.read.format("tidemark_prices").option("path", path).option("pushdown", "false").load()
    assert plain.filter("ticker = 'CC' AND adj_close > 40").count() == 19


def test_pushed_filters_cut_what_is_read(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, StringContains

    path = str(tmp_path / "prices")
    prices(spark, path)
    reader = PriceReader({"path": path, "splits": "BB,DD"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("date",), D("2024-02-20")), EqualTo(("ticker",), "BB"), IsNotNull(("date",)), StringContains(("ticker",), "B"), EqualTo(("adj_close",), 3.0)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "StringContains", "EqualTo"]
    assert [(p.low, p.high) for p in reader.partitions()] == [("BB", "DD")]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 10


def telemetry(spark):
    rows = [(T0 + dt.timedelta(days=d, minutes=i), "tool", "search" if i % 2 else "fetch", None, i % 3 > 0, 10.0 * i, 0 if d < 20 else 1) for d in (0, 1, 20, 21) for i in range(6)]
    rows += [(T0 + dt.timedelta(days=d), "initialize", None, "ChatGPT", True, None, 0 if d < 20 else 1) for d in (0, 21)] + [(T0, "http", None, None, True, None, 0)]
    return spark.createDataFrame(rows, "ts timestamp, kind string, tool string, client string, success boolean, duration_ms double, b int")


def test_counters_leave_the_state_when_their_day_is_out_of_the_retention(spark, tmp_path):
    own = spark.newSession()
    own.conf.set(*jobs.ROCKSDB)
    path = str(tmp_path / "counters")
    df = own.createDataFrame(telemetry(spark).collect(), telemetry(spark).schema)
    source = str(tmp_path / "source")
    sizes = []
    for b in (0, 1):
        log = jobs.updates_table(retention.day_counters(as_stream(df, (b,), "b", source), days=7, late="1 hour"), "c", path=path)
        state = own.read.format("statestore").option("stateVarName", "days").load(f"{path}/checkpoint")
        sizes.append(state.count())
    assert sizes == [5, 5]  # two tools on two days and a client on one: the old days are gone when new ones are there
    live = {(r.kind, r.name, str(r.day)): (r.calls, r.successes, r.max_ms) for r in retention.live_counters(log).collect()}
    assert live == {("tool", "search", "2024-01-21"): (3, 2, 50), ("tool", "fetch", "2024-01-21"): (3, 2, 40), ("tool", "search", "2024-01-22"): (3, 2, 50),
                    ("tool", "fetch", "2024-01-22"): (3, 2, 40), ("client", "ChatGPT", "2024-01-22"): (1, 1, 0)}
    assert log.filter("ended").count() == 5


def test_audit_days_are_dropped_and_the_edge_day_cut(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [(i, T0 + dt.timedelta(hours=6 * i)) for i in range(40)]
    retention.write_by_day(spark.createDataFrame(rows, "id int, at timestamp"), path)
    got = retention.prune_days(spark, path, T0 + dt.timedelta(days=4)).first()
    assert (got.before, got.after, got.deleted, got.days_dropped) == (40, 24, 16, 4)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(16, 40))
    again = retention.prune_days(spark, path, T0 + dt.timedelta(days=4)).first()
    assert (again.before, again.after, again.days_dropped) == (24, 24, 0)


def test_nested_export_comes_back_whole(spark, tmp_path):
    lists = spark.createDataFrame([("w1", "k", "B list", ["AAPL", "KO"]), ("w2", "k", "A list", ["GE"]), ("w3", "j", "C", [])], "watchlist_id string, key_id string, name string, tickers array<string>")
    latest = spark.createDataFrame([("w1", "s1", T0)], "watchlist_id string, snapshot_id string, created_at timestamp")
    alerts = spark.createDataFrame([("w1", "KO", "watch", 2, "open"), ("w1", "AAPL", "alert", 3, "open"), ("w1", "GE", "watch", 2, "dismissed")], "watchlist_id string, ticker string, action string, severity bigint, status string")
    signals = spark.createDataFrame([("s1", "KO", "watch", 30.0), ("s1", "AAPL", "alert", 60.0)], "snapshot_id string, ticker string, action string, score double")
    for given, want in ((None, None), (signals, [("AAPL", "alert", 60.0), ("KO", "watch", 30.0)])):
        nested = writers.nested_workspaces(lists, latest, alerts, given)
        path = str(tmp_path / f"export{given is not None}")
        writers.write_workspaces(nested, path)
        objects = {o["key_id"]: o for f in (tmp_path / f"export{given is not None}").rglob("*.json") for o in map(json.loads, open(f))}
        assert [w["name"] for w in objects["k"]["watchlists"]] == ["A list", "B list"] and objects["j"]["watchlists"][0]["alerts"] == []
        assert [a["ticker"] for a in objects["k"]["watchlists"][1]["alerts"]] == ["AAPL", "GE", "KO"]
        back = writers.read_workspaces(spark, path).collect()
        assert sorted((r.watchlist_id, r.alert_ticker or "") for r in back) == [("w1", "AAPL"), ("w1", "GE"), ("w1", "KO"), ("w2", ""), ("w3", "")]
        snap = next(r for r in back if r.watchlist_id == "w1")
        assert snap.latest_snapshot_id == "s1" and (snap.signals if want is None else [tuple(s) for s in snap.signals]) == want


def test_sections_are_ranked_counted_and_cut(spark):
    rows = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 5.0), ("a", "z", 4.0), ("b", "x", 1.0)], "k string, name string, v double")
    got = pages.section(rows, ["k"], "list", [F.col("v").desc()], 2, name="name", amount="v").collect()
    assert sorted((r.k, r.section, r.place, r.available, r.entry.name, r.entry.amount, r.entry.code) for r in got) == [
        ("a", "list", 1, 3, "y", 5.0, None), ("a", "list", 2, 3, "z", 4.0, None), ("b", "list", 1, 1, "x", 1.0, None)]
    whole = pages.section(rows, [], "all", ["v", "k"], 2, name="name").collect()
    assert [(r.place, r.available, r.entry.name) for r in sorted(whole, key=lambda r: r.place)] == [(1, 4, "x"), (2, 4, "x")]
    windows = pages.result_windows(pages.page(pages.section(rows, ["k"], "list", ["v"], 1), pages.section(rows, ["k"], "more", ["v"])), "k").collect()
    assert sorted((r.k, r.section, r.returned, r.available) for r in windows) == [("a", "list", 1, 3), ("a", "more", 3, 3), ("b", "list", 1, 1), ("b", "more", 1, 1)]


def test_page_of_a_ticker_with_an_excluded_fund(spark):
    q = D("2026-03-31")
    rows = [("B", "ADD", 130.0, 100.0, 0.2, 0.3), ("P", "NEW", 35.0, 0.0, 0.1, None), ("G", "EXIT", 0.0, 80.0, 0.0, -1.0), ("X", "ADD", 9e9, 1.0, 0.9, 8.0), ("B", "HOLD", 1.0, 1.0, 0.1, 0.0)]
    m = spark.createDataFrame([(c, q, f"c{i}", "", "AAPL", k, cv, pv, w, s) for i, (c, k, cv, pv, w, s) in enumerate(rows)],
                              "cik string, report_date date, cusip string, put_call string, ticker string, move string, curr_value double, prev_value double, curr_weight double, share_change_pct double")
    gate = spark.createDataFrame([(c, f"Fund {c}", "trusted" if c != "X" else "quarantined", 0 if c != "X" else 3, c != "X", ["current_aum_jump"] if c == "X" else []) for c in "BPGX"],
                                 "cik string, label string, status string, status_rank int, signal_eligible boolean, reasons array<string>")
    flow = spark.createDataFrame([(q, "AAPL", 61.0, "alert", ["new_position"])], "report_date date, ticker string, score double, action string, triggers array<string>")
    got = {}
    for r in pages.ticker_pages(m, gate, flow).orderBy("section", "place").collect():
        got.setdefault(r.section, []).append((r.entry.name, r.entry.code, r.entry.amount))
    assert got["holders"] == [("Fund B", "B", 131.0), ("Fund P", "P", 35.0)]
    assert got["movements"] == [("Fund B", "ADD", 130.0), ("Fund G", "EXIT", 80.0), ("Fund P", "NEW", 35.0)]
    assert got["excluded"] == [("Fund X", "quarantined", None)] and got["confidence"] == [(None, "partial", None)] and got["score"] == [(None, "alert", 61.0)]


def test_links_are_escaped(spark):
    row = with_links(spark.createDataFrame([("BRK/B",)], "ticker string"), "https://example.org").first()
    assert tuple(row.links) == ("https://example.org/stocks/BRK%2FB", "https://example.org/api/stocks/BRK%2FB")

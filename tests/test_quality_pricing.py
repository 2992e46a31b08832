import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pricing, quality, resolve
from tidemark.sources import market

D = dt.date.fromisoformat
R = "cik string, report_date date, accession string, form string, filing_date date, total_value double, n_positions bigint"
QUARTERS = ["2024-03-31", "2024-06-30", "2024-09-30"]


def series(spark, spec):
    rows = [(c, D(q), f"{c}-{q}", "13F-HR", D(q), float(v), 10) for c, vs in spec.items() for q, v in zip(QUARTERS, vs) if v]
    return spark.createDataFrame(rows, R)


def fund_rows(spark, labels):
    return spark.createDataFrame(list(labels.items()), "cik string, label string")


def test_unit_error_gives_two_jumps_and_one_candidate(spark):
    r = series(spark, {"u": [1_000_000, 1_000, 1_100_000], "s": [0, 1_000, 1_100]})
    funds = fund_rows(spark, {"u": "Unit Bug Fund", "s": "Stable Fund"})
    s = quality.quality_summary(r, funds).collect()[0]
    assert (s.aum_jump_warnings, s.current_aum_jump_warnings, s.historical_aum_jump_warnings) == (2, 1, 1)
    assert (s.unit_scale_candidates, s.current_quarter, s.status) == (1, D("2024-09-30"), "review")
    c = quality.unit_candidates(r).collect()[0]
    assert (c.action, c.report_date) == ("MULTIPLY_1000", D("2024-06-30"))


def test_signal_quarter_waits_for_enough_funds(spark):
    r = series(spark, {**{f"c{i}": [1, 1, 0] for i in range(20)}, "early": [1, 1, 1]})
    assert quality.signal_quarter(r).collect()[0][0] == D("2024-06-30")
    assert quality.signal_quarter(series(spark, {"a": [1, 0, 0], "b": [0, 1, 0]})).collect()[0][0] == D("2024-06-30")


def test_gate_statuses_and_reasons(spark):
    r = series(spark, {"ok": [100, 100, 110], "jump": [100, 100, 30_000], "crit": [100, 100, 200_000], "stale": [100, 100, 0],
                       "old": [1, 1_000, 1_000], "d1": [5, 5, 5], "d2": [5, 5, 5]})
    part = spark.createDataFrame([("thin", D("2024-09-30"), "t", "13F-HR/A", D("2024-11-15"), 5.0, 3)], R)
    labels = {c: c.upper() for c in ("ok", "jump", "crit", "stale", "old", "thin", "none")} | {"d1": "Same  Name", "d2": "same name"}
    g = {x.cik: (x.status, x.reasons) for x in quality.quality_gate(r.unionByName(part), fund_rows(spark, labels)).collect()}
    assert g["ok"] == ("trusted", ["passed_automated_quality_gate"])
    assert g["jump"] == ("degraded", ["current_aum_jump"])
    assert g["crit"] == ("quarantined", ["current_aum_jump"])
    assert g["stale"] == ("stale", ["stale_fund"])
    assert g["old"][0] == "trusted"  # an old anomaly does not count now
    assert g["thin"] == ("quarantined", ["partial_amendment_latest"])
    assert g["none"] == ("quarantined", ["missing_latest_filing", "stale_fund"])
    assert g["d1"][0] == g["d2"][0] == "quarantined"


def test_valuation_of_priced_option_and_unpriced(spark):
    prices = spark.createDataFrame(
        [("AAPL", D("2024-06-28"), 100.0), ("AAPL", D("2024-09-27"), 120.0), ("NVDA", D("2024-06-28"), 50.0),
         ("NVDA", D("2024-09-27"), 40.0), ("OLD", D("2024-06-01"), 9.0)], "ticker string, date date, adj_close double")
    snap = spark.createDataFrame(
        [("a", D("2024-06-30"), c, t, pc, s, v) for c, t, pc, s, v in (
            ("1", "AAPL", "", 100.0, 10_000.0), ("2", "NVDA", "", 50.0, 2_500.0), ("1", "AAPL", "Call", 1.0, 99_999.0),
            ("3", None, "", 1.0, 7.0), ("4", "OLD", "", 1.0, 5.0))],
        "accession string, report_date date, cusip string, ticker string, put_call string, shares double, value_usd double")
    f = spark.createDataFrame([("AAPL", None, 1000.0)], "ticker string, market_cap double, shares_outstanding double")
    v = pricing.value_portfolios(snap, prices, F.lit("2024-09-30").cast("date"), f)
    by = {(r.cusip, r.put_call): r for r in v.collect()}
    a, n = by[("1", "")], by[("2", "")]
    assert (a.current_value, n.current_value, a.reconcile_ratio, a.basis_date) == (12_000.0, 2_000.0, 1.0, D("2024-06-28"))
    assert a.pnl_pct == pytest.approx(0.2) and n.pnl_pct == pytest.approx(-0.2) and a.pct_of_company == 0.1
    assert {k: r.status for k, r in by.items() if r.status != "priced"} == {("1", "Call"): "option", ("3", ""): "no_ticker", ("4", ""): "no_price"}
    assert by[("1", "Call")].current_value == 99_999.0
    assert sum(r.current_weight for r in by.values()) == pytest.approx(1.0)
    t = pricing.valuation_totals(v, "accession").collect()[0]
    assert (t.pnl_abs, t.pnl_pct, t.unpriced_value) == (1_500.0, pytest.approx(0.12), pytest.approx(100_011.0))


def test_price_file_report(spark):
    rows = spark.createDataFrame(
        [("AAPL", "2024-01-02", "100"), ("AAPL", "2024-01-02", "101"), ("AAPL", "2024-02-20", "0"), ("AAPL", "2024-03-15", "120")],
        "ticker string, date string, adj_close string")
    universe = spark.createDataFrame([("AAPL",), ("MSFT",)], "ticker string")
    d = lambda s: F.lit(s).cast("date")
    r = pricing.validate_prices(rows, universe, d("2024-01-02"), d("2024-03-15")).collect()[0]
    assert (r.status, r.duplicate_rows, r.invalid_rows, r.tickers_empty, r.tickers_partial_history, r.major_gaps) == ("review", 1, 1, 1, 0, 1)
    good = rows.filter("adj_close in ('100', '120')")
    r = pricing.validate_prices(good, None, d("2024-01-02"), d("2024-03-15"), 100).collect()[0]
    assert r.status == "ready"


def test_forward_returns_step_by_price_rows(spark):
    day = D("2024-08-01")
    prices = spark.createDataFrame([("NVDA", day + dt.timedelta(days=i), 100.0 + i) for i in range(180)], "ticker string, date date, adj_close double")
    points = spark.createDataFrame([("NVDA", D("2024-08-02")), ("NVDA", D("2024-07-01")), ("NVDA", D("2025-01-20")), ("NVDA", D("2030-01-01")), ("X", day)],
                                   "ticker string, as_of date")
    r = {x.as_of: x for x in pricing.forward_returns(points, prices).collect()}
    first = r[D("2024-08-02")]
    assert (first.execution_timestamp, first.adjusted_entry_price) == (D("2024-08-03"), 102.0)
    assert first.forward_return_120d > first.forward_return_20d == pytest.approx(20 / 102, abs=1e-8)
    assert r[D("2024-07-01")].execution_timestamp == D("2024-08-02")
    late = r[D("2025-01-20")]
    assert late.forward_return_20d is None and late.adjusted_exit_price is None
    assert set(r) == {D("2024-08-02"), D("2024-07-01"), D("2025-01-20")}


def test_resolution_chain(spark):
    text = lambda rows, schema: spark.createDataFrame(rows, schema)
    items = text([("037833100", "Apple Inc"), ("037833200", "Apple Inc."), ("084670108", "BERKSHIRE HATHAWAY INC"), ("999999999", "Nobody"),
                  ("111111111", "Fresh miss"), ("222222222", "Stale miss"), ("333333333", "Kept")], "cusip string, issuer string")
    now = dt.datetime(2024, 6, 1)
    ago = lambda d: now - dt.timedelta(days=d)
    cache = text([("111111111", None, "Fresh miss", None, "none", 0.0, ago(5)), ("222222222", None, "x", None, "none", 0.0, ago(40)),
                  ("333333333", "KEP", "Kept", None, "openfigi", 0.95, ago(900))],
                 "cusip string, ticker string, name string, figi string, source string, confidence double, resolved_at timestamp")
    over = text([("222222222", "STL", None)], "cusip string, ticker string, name string")
    mapping = text([("037833100", "AAPL", "APPLE INC", "BBG")], "cusip string, ticker string, name string, figi string")
    names = resolve.name_index(text([("Berkshire Hathaway Inc", "BRK-B", 1), ("BERKSHIRE HATHAWAY CORP", "BRK-A", 2)], "title string, ticker string, file_order int"))
    r = {x.cusip: x for x in resolve.resolve_chain(items, cache, over, mapping, names, F.lit(now)).collect()}
    got = {c: (x.ticker, x.source, x.confidence) for c, x in r.items()}
    assert got == {
        "037833100": ("AAPL", "openfigi", 0.95), "037833200": ("AAPL", "cusip_prefix", 0.85), "084670108": ("BRK-B", "sec_name", 0.6),
        "999999999": (None, "none", 0.0), "111111111": (None, "none", 0.0), "222222222": ("STL", "manual", 1.0), "333333333": ("KEP", "openfigi", 0.95)}
    assert r["999999999"].name == "Nobody"


def test_price_documents(spark):
    docs = spark.createDataFrame([("A", "Date,Open,Close\n2024-01-02,1,5.5\nbad,1,2\n2024-01-03,1,x"), ("B", "No data")], "ticker string, body string")
    assert [(r.ticker, r.date, r.adj_close) for r in market.parse_price_csv(docs).collect()] == [("A", D("2024-01-02"), 5.5)]
    chart = '{"chart":{"result":[{"timestamp":[1704153600,1704240000],"indicators":{"quote":[{"close":[1.0,null]}],"adjclose":[{"adjclose":[2.5,null]}]}}]}}'
    df = spark.createDataFrame([("A", chart)], "ticker string, json string")
    assert [(r.date, r.adj_close) for r in market.parse_chart_json(df).collect()] == [(D("2024-01-02"), 2.5)]
    with pytest.raises(Exception, match="chart error"):
        market.parse_chart_json(spark.createDataFrame([("A", '{"chart":{"error":"no such symbol"}}')], "ticker string, json string")).collect()

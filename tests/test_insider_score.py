import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import score as scoring
from tidemark.operators import insider, moves
from tidemark.plans import features as feat
from tidemark.sources import documents

D = dt.date.fromisoformat
AS_OF = D("2026-05-31")
TRADE = ("ticker string, issuer_name string, accession string, filing_date date, transaction_date date, owner_cik string, owner_name string, "
         "officer_title string, is_officer boolean, is_director boolean, is_ten_percent_owner boolean, transaction_code string, acquired_disposed string, "
         "shares double, price_per_share double, shares_owned_after double")


def trade(ticker, owner, title, days, shares, price, after, code="P", side="A", filed=1):
    d = AS_OF - dt.timedelta(days=days)
    officer = bool(title)
    return (ticker, ticker + " Inc", f"{ticker}-{owner}-{days}", d + dt.timedelta(days=filed), d, owner, owner, title, officer, not officer, False,
            code, side, float(shares), float(price), float(after))


def activity(spark, rows):
    trades = spark.createDataFrame(rows, TRADE)
    points = trades.select("ticker").distinct().withColumn("as_of", F.lit(AS_OF))
    return {r.ticker: r for r in insider.insider_activity(trades, points).collect()}


def test_cluster_of_two_top_executives(spark):
    a = activity(spark, [trade("ATLC", "1", "Chief Executive Officer", 4, 50_000, 84, 270_000), trade("ATLC", "2", "CFO", 2, 18_000, 83, 90_000),
                         trade("ATLC", "1", "Chief Executive Officer", 4, 10_000, 10, 280_000, code="M")])["ATLC"]
    assert (a.n_buyers, a.n_c_suite_buyers, a.days_since_last_buy, a.recent_cluster_n, a.n_visible) == (2, 2, 2, 2, 3)
    assert a.max_stake_increase_pct == pytest.approx(0.25, abs=0.0001) and a.buy_value_usd == 50_000 * 84 + 18_000 * 83


def test_nothing_filed_later_is_visible(spark):
    rows = [trade("NVDA", "1", "", 5, 100, 10, 0), trade("AAPL", "1", "", 5, 100, 10, 0, filed=9), trade("OLD", "1", "", 91, 1, 1, 0),
            trade("EDGE", "1", "", 90, 1, 1, 0)]
    assert set(activity(spark, rows)) == {"NVDA", "EDGE"}


def test_windows_in_one_pass_equal_single_windows(spark):
    rows = [trade("A", str(i), "", i * 7, 10 + i, 5, 100) for i in range(26)]
    trades = spark.createDataFrame(rows, TRADE)
    points = trades.select("ticker").distinct().withColumn("as_of", F.lit(AS_OF))
    many = {r.window_days: r for r in insider.activity_by_window(trades, points, (30, 90, 180)).collect()}
    for w in (30, 90, 180):
        one = insider.insider_activity(trades, points, w).collect()[0]
        assert (many[w].n_buyers, many[w].buy_value_usd, many[w].conviction_units) == (one.n_buyers, one.buy_value_usd, one.conviction_units)


def test_score_fresh_beats_stale_and_quadrants(spark):
    fresh = activity(spark, [trade("T", "1", "CEO", 2, 50_000, 84, 270_000), trade("T", "2", "CFO", 2, 18_000, 83, 96_000)])["T"]
    stale = activity(spark, [trade("T", "1", "CEO", 88, 50_000, 84, 270_000), trade("T", "2", "CFO", 88, 18_000, 83, 96_000)])["T"]
    side = spark.createDataFrame([("T", 4, 0, 2, 4.0, 6e8)], "ticker string, funds_accumulating bigint, funds_trimming bigint, conviction_funds bigint, avg_weight_pct double, total_value_usd double")
    def scored(a):
        df = spark.createDataFrame([a])
        return feat.score_table(side, df.drop("as_of")).collect()[0]
    f, s = scored(fresh), scored(stale)
    assert f.quadrant == "conviction" and f.score > 84 and f.score > s.score + 3
    assert f.score == pytest.approx(f.institutional_score + f.insider_score + f.dollar_score + f.agreement_score + f.penalty_score)
    alone = scoring.add_score(side).collect()[0]
    assert (alone.quadrant, alone.insider_score, alone.y) == ("institutional", 0.0, 0.0)
    out = spark.createDataFrame([("P", 0, 3, 1, 2.4e6)], "ticker string, funds_accumulating bigint, funds_trimming bigint, n_sellers bigint, sell_value_usd double")
    p = scoring.add_score(out).collect()[0]
    assert (p.quadrant, p.score) == ("distribution", 0.0) and p.x == pytest.approx(-0.5)


def test_default_universe_leaves_out_notes_and_flags_them_on_request(spark):
    rows = [("1", D("2024-06-30"), "C", "", t, "Issuer", title, "NEW", 10.0, 0.5, D("2024-08-14"), "acc") for t, title in
            (("NVDA", "COM"), ("BAD12345", "CONV NOTE"), ("XEUR", "COM"))]
    m = spark.createDataFrame(rows, "cik string, report_date date, cusip string, put_call string, ticker string, issuer string, title_of_class string, "
                              "move string, curr_value double, curr_weight double, filing_date date, accession string")
    got = {r.ticker: r.quality_flags for r in feat.institutional_signals(m, include_non_priceable=True).collect()}
    assert got["BAD12345"] == ["non_common_equity_title", "non_priceable_ticker"] and got["NVDA"] == []
    assert {r.ticker for r in feat.institutional_signals(m).collect()} == {"NVDA", "XEUR"}


FORM4 = """<?xml version="1.0"?><ownershipDocument><periodOfReport>2026-05-20</periodOfReport>
<issuer><issuerCik>1234</issuerCik><issuerName>Atlas</issuerName><issuerTradingSymbol>atlc</issuerTradingSymbol></issuer>
<reportingOwner><reportingOwnerId><rptOwnerCik>77</rptOwnerCik><rptOwnerName>J. Marlin</rptOwnerName></reportingOwnerId>
<reportingOwnerRelationship><isOfficer>true</isOfficer><officerTitle>Chief Executive Officer</officerTitle></reportingOwnerRelationship></reportingOwner>
<reportingOwner><reportingOwnerId><rptOwnerCik>78</rptOwnerCik></reportingOwnerId></reportingOwner>
<nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"""
TXN = """<nonDerivativeTransaction><securityTitle><value>Common</value></securityTitle><transactionDate><value>2026-05-20</value></transactionDate>
<transactionCoding><transactionFormType>4</transactionFormType><transactionCode>{}</transactionCode></transactionCoding>
<transactionAmounts><transactionShares><value>{}</value></transactionShares><transactionPricePerShare><value>{}</value></transactionPricePerShare></transactionAmounts>
<postTransactionAmounts><sharesOwnedFollowingTransaction><value>270,000</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction>"""


def test_ownership_document(spark):
    good = FORM4.format(TXN.format("P", "50,000", "84") + TXN.format("m", "10000", "10"))
    docs = spark.createDataFrame([("a", "", good), ("b", "2026-05-21", "<ownershipDocument><broken>"), ("c", "", FORM4.format(""))],
                                 "accession string, filing_date string, xml string")
    rows = documents.parse_form4(docs).orderBy("transaction_code").collect()
    assert [(r.accession, r.transaction_code, r.shares, r.price_per_share) for r in rows] == [("a", "M", 10000.0, 10.0), ("a", "P", 50000.0, 84.0)]
    r = rows[1]
    assert (r.issuer_cik, r.issuer_ticker, r.owner_cik, r.is_officer, r.acquired_disposed, r.direct, r.filing_date, r.shares_owned_after) == (
        "0000001234", "ATLC", "77", True, "A", True, "2026-05-20", 270000.0)
    assert [(x.accession, x.reject) for x in documents.rejected(docs, "form4").collect()] == [("b", "malformed")]


def test_entity_bomb_and_large_documents_are_quarantined(spark):
    ok = "<n:informationTable xmlns:n='u'><n:infoTable><n:cusip>abc</n:cusip><n:value>1,000</n:value></n:infoTable></n:informationTable>"
    docs = spark.createDataFrame([("ok", ok), ("bomb", '<!DOCTYPE x [<!ENTITY a "b">]>' + ok), ("empty", " "), ("none", None), ("big", ok + " " * 500)],
                                 "accession string, xml string")
    rows = documents.parse_info_tables(docs, max_bytes=400).collect()
    assert [(r.accession, r.cusip, r.value, r.shares, r.sh_prn_type) for r in rows] == [("ok", "ABC", 1000.0, 0.0, "SH")]
    assert {r.accession: r.reject for r in documents.rejected(docs, max_bytes=400).collect()} == {
        "bomb": "dtd_or_entity", "empty": "empty", "none": "empty", "big": "too_large"}


def test_issuer_mismatch_is_dropped_once(spark):
    parsed = spark.createDataFrame([("XOM", "34088", "a", "Exxon", "1"), ("XOM", "999", "b", "Other", "2"), ("XOM", "999", "b", "Other", "2")],
                                   "ticker string, issuer_cik string, accession string, issuer_name string, owner_cik string")
    expected = spark.createDataFrame([("XOM", "0000034088")], "ticker string, cik string")
    kept, dropped = insider.guard_issuers(parsed, expected)
    assert [r.accession for r in kept.collect()] == ["a"] and [r.accession for r in dropped.collect()] == ["b"]


def test_a_trade_without_a_date_counts_as_old_as_the_window(spark):
    who = "struct<name: string, role: string, is_c_suite: boolean>"
    seen = spark.createDataFrame(
        [("T", dt.date(2024, 6, 30), o, dt.date(2024, 6, 1), d, 1, 1, 0, 1.0, 100.0, 1.0, 0.0, 0.0, 0.0, ("a", (o, "CEO", True)), None, "I")
         for o, d in (("dated", dt.date(2024, 6, 29)), ("undated", None), ("ahead", dt.date(2024, 7, 5)))],
        "ticker string, as_of date, owner string, filing_date date, transaction_date date, n_rows bigint, n_buys bigint, n_sells bigint, buy_shares double, buy_value double, "
        f"buy_weight double, buy_stake double, sell_shares double, sell_value double, first_buy struct<accession: string, who: {who}>, first_sell struct<accession: string, who: {who}>, issuer_name string")
    got = {r.owner: r for r in insider.owner_activity(seen, 90).collect()}
    assert {o: r.last_buy_age for o, r in got.items()} == {"dated": 1, "undated": 90, "ahead": 0}
    assert got["undated"].recent_usd < got["dated"].recent_usd

"""Registered queries on prices and valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pricing
from tidemark.plans.driver_tables import Tables
from tidemark.plans.filing_queries import money, ratio


def _valued(t: Tables):
    prices = t.prices()
    today = F.lit("2027-11-01").cast("date")
    return pricing.value_portfolios(t.snapshots(weights=False), prices, today, t.fundamentals())


def j4_price_asof(spark, sf):
    """Close on or before every month end of the price history."""
    t = Tables(spark, sf)
    prices = t.prices()
    points = prices.select("ticker", F.last_day("date").alias("as_of")).distinct()
    return pricing.close_on_or_before(points, prices, 7).select("ticker", "as_of", "price_date", ratio("price"))


def j4_latest_close(spark, sf):
    t = Tables(spark, sf)
    prices = t.prices()
    today = F.lit("2027-11-01").cast("date")
    return pricing.latest_close(prices, prices, today, 10).select("ticker", "price_date", ratio("price"))


def j10_forward_returns(spark, sf):
    """Entry price and returns for a point at every 7th of a month."""
    t = Tables(spark, sf)
    prices = t.prices()
    points = prices.select("ticker", F.date_add(F.trunc("date", "month"), 6).alias("as_of")).distinct()
    out = pricing.forward_returns(points, prices)
    return out


def j17_fundamentals_join(spark, sf):
    v = _valued(Tables(spark, sf))
    return v.filter("market_cap is not null").select("accession", "cusip", money("market_cap"), ratio("pct_of_company"))


def v1_portfolio_valuation(spark, sf):
    v = _valued(Tables(spark, sf))
    return v.select("accession", "cusip", "put_call", "status", money("current_value"), ratio("current_weight"),
                    money("pnl_abs"), ratio("pnl_pct"), F.round("reconcile_ratio", 5).alias("reconcile_ratio"))


def v1_valuation_totals(spark, sf):
    v = pricing.valuation_totals(_valued(Tables(spark, sf)), "accession")
    return v.select("accession", *[money(c) for c in ("reported_total", "current_total", "priced_basis_total",
                    "priced_current_total", "pnl_abs", "unpriced_value")], ratio("pnl_pct"))


def f24_valuation_status(spark, sf):
    v = _valued(Tables(spark, sf))
    return v.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def l1_top_by_current_value(spark, sf):
    from tidemark.operators.holdings import top_positions
    v = _valued(Tables(spark, sf)).withColumn("current_value", F.round("current_value", 2))
    out = top_positions(v, 3, by="current_value")
    return out.select("accession", F.col("position_rank").cast("long").alias("position_rank"), "cusip", "put_call", "current_value")


def _raw_prices(t: Tables):
    """A raw price file: text columns, with some bad dates, bad prices and repeats."""
    l, p = t.read("lineitem"), t.read("part")
    from tidemark.plans.driver_tables import brand_no, day, ticker_of
    odd = F.col("l_linenumber")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select(
        F.when((odd == 7) & (F.col("l_quantity") == 50), "").otherwise(F.lower(ticker_of(brand_no()))).alias("ticker"),
        F.when((odd == 6) & (F.col("l_quantity") == 49), "soon").otherwise(day("l_shipdate").cast("string")).alias("date"),
        F.when((odd == 5) & (F.col("l_quantity") == 48), "-1").otherwise(F.col("l_extendedprice").cast("string")).alias("adj_close"),
    )


def a15_price_validation(spark, sf):
    t = Tables(spark, sf)
    start, end = F.lit("2021-01-04").cast("date"), F.lit("2027-10-30").cast("date")
    universe = t.fundamentals().select("ticker").unionByName(spark.createDataFrame([("ZZZ",)], "ticker string"))
    return pricing.validate_prices(_raw_prices(t), universe, start, end, 3)


def a15_price_row_problems(spark, sf):
    t = Tables(spark, sf)
    bad = pricing.price_row_problems(_raw_prices(t)).select(F.explode("problems").alias("problem"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def l10_report_samples(spark, sf):
    """The rows that the report samples: bad rows and major gaps."""
    t = Tables(spark, sf)
    bad = pricing.price_row_problems(_raw_prices(t)).filter(F.size("problems") > 0).select(
        F.lit("invalid_row").alias("sample"), F.col("t").alias("ticker"), F.col("date"), F.array_join("problems", ";").alias("detail"))
    d = F.lit("2021-01-04").cast("date")
    gaps = pricing.price_history(t.prices().select("ticker", "date"), t.fundamentals(), d, d).filter("max_gap_days > 3").select(
        F.lit("major_gap").alias("sample"), "ticker", F.col("gap_from").cast("string").alias("date"), F.col("max_gap_days").cast("string").alias("detail"))
    return bad.unionByName(gaps)


def u1_price_provider(spark, sf):
    """Any (ticker, date, adj_close) table serves as the price source: here order totals."""
    t = Tables(spark, sf)
    from tidemark.plans.driver_tables import day, ticker_of
    o = t.read("orders")
    own = o.groupBy(ticker_of((F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"), day("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("adj_close"))
    points = t.snapshots(weights=False).filter("ticker is not null").select("ticker", F.col("report_date").alias("as_of")).distinct()
    return pricing.close_on_or_before(points, own, 7).select("ticker", "as_of", "price_date", "price")


def a16_history_coverage(spark, sf):
    t = Tables(spark, sf)
    start, end = F.lit("2021-01-04").cast("date"), F.lit("2027-10-30").cast("date")
    out = pricing.price_history(t.prices().select("ticker", "date"), t.fundamentals(), start, end)
    return out.select("ticker", "n_days", "first_date", "last_date", "missing_start", "missing_end", "history")


def w9_largest_gap(spark, sf):
    t = Tables(spark, sf)
    d = F.lit("2021-01-04").cast("date")
    out = pricing.price_history(t.prices().select("ticker", "date"), t.fundamentals(), d, d)
    return out.select("ticker", F.col("max_gap_days").cast("long").alias("max_gap_days"), "gap_from", "gap_to")


def k6_merge_prices(spark, sf):
    """Old prices kept for known tickers; tickers of the second half of the list are new."""
    t = Tables(spark, sf)
    prices = t.prices()
    known = prices.filter("ticker < 'TC'")
    return pricing.merge_prices(known, prices.withColumn("adj_close", F.col("adj_close") + 1)).select(
        "ticker", "date", ratio("adj_close"))


def k6_merge_prices_forced(spark, sf):
    t = Tables(spark, sf)
    prices = t.prices()
    fresh = prices.filter("date >= DATE'2025-01-01'").withColumn("adj_close", F.col("adj_close") + 1)
    return pricing.merge_prices(prices, fresh, force=True).select("ticker", "date", ratio("adj_close"))


def w15_dedupe_last_wins(spark, sf):
    """Rows per (ticker, date) in the raw price file, and how many a merge removes."""
    days = pricing.price_days(_raw_prices(Tables(spark, sf)))
    return days.groupBy("ticker").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("copies") - 1).alias("dropped"))


QUERIES = {f.__name__: f for f in (
    j4_price_asof, j4_latest_close, j10_forward_returns, j17_fundamentals_join,
    v1_portfolio_valuation, v1_valuation_totals, f24_valuation_status, l1_top_by_current_value,
    a15_price_validation, a15_price_row_problems, l10_report_samples, u1_price_provider, a16_history_coverage, w9_largest_gap,
    k6_merge_prices, k6_merge_prices_forced, w15_dedupe_last_wins,
)}

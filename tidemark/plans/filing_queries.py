"""Registered queries on filings, moves and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import consensus, holdings, moves
from tidemark.plans.driver_tables import Tables


def money(c: str, alias: str | None = None):
    return F.round(c, 2).alias(alias or c)


def ratio(c: str, alias: str | None = None):
    return F.round(c, 6).alias(alias or c)


def all_moves(t: Tables):
    return t.moves()


def a1_portfolio_positions(spark, sf):
    t = Tables(spark, sf)
    positions = t.holdings()
    out = holdings.add_weights(positions, holdings.filing_totals(positions))
    return out.select("accession", "cusip", "put_call", "issuer", "title_of_class",
                      money("value_usd"), "shares", ratio("weight"))


def a2_filing_totals(spark, sf):
    return Tables(spark, sf).filings().select("accession", money("total_value"), "n_positions")


def w1_resolved_filings(spark, sf):
    return Tables(spark, sf).resolved().select("cik", "report_date", "accession", "form", "filing_date", "n_positions")


def w2_position_weights(spark, sf):
    return Tables(spark, sf).snapshots().select("accession", "cusip", "put_call", ratio("weight"))


def w3_previous_quarter(spark, sf):
    t = Tables(spark, sf)
    return t.chain(flawed=True).select("cik", "report_date", "accession", "prev_report_date", "prev_accession")


def w6_latest_per_fund(spark, sf):
    t = Tables(spark, sf)
    filings = holdings.filing_totals(t.holdings(flawed=True))
    current = holdings.current_filing(holdings.resolve_filings(filings)).select(
        "cik", F.col("report_date").alias("quarter"), F.col("accession").alias("current_accession"))
    newest = holdings.latest_filing_by_date(filings).select("cik", F.col("accession").alias("newest_accession"), "filing_date")
    return current.join(newest, "cik")


def w7_latest_portfolios(spark, sf):
    t = Tables(spark, sf)
    return holdings.latest_portfolios(t.resolved(), 2).select("cik", "report_date", "accession", F.col("recency").cast("long").alias("recency"))


def w10_conviction_timeline(spark, sf):
    out = holdings.position_timeline(Tables(spark, sf).snapshots())
    return out.select("cik", "cusip", "report_date", "shares", money("value_usd"), ratio("weight"),
                      "shares_change", F.col("quarter_no").cast("long").alias("quarter_no"))


def w11_value_timeline(spark, sf):
    series = holdings.value_timeline(Tables(spark, sf).resolved())
    point = F.transform("series", lambda s: F.concat_ws(":", s["report_date"].cast("string"), F.round(F.round(s["total_value"], 2), 0).cast("long").cast("string")))
    return series.select("cik", F.size("series").cast("long").alias("n_points"), F.array_join(point, ",").alias("sparkline"))


def p7_preferred_filings(spark, sf):
    out = holdings.preferred_filings(Tables(spark, sf).filings(), max_quarters=None)
    return out.select("cik", "report_date", "accession", "form", F.col("quarter_rank").cast("long").alias("quarter_rank"))


def p8_latest_originals(spark, sf):
    out = holdings.latest_originals(Tables(spark, sf).filings(), 2)
    return out.select("cik", "accession", "filing_date", F.col("filing_rank").cast("long").alias("filing_rank"))


def j1_snapshot_join(spark, sf):
    t = Tables(spark, sf)
    return t.snapshots().join(t.funds(), "cik").select(
        "cik", "label", "report_date", "cusip", "put_call", money("value_usd"), "shares", ratio("weight"))


def j2_quarter_moves(spark, sf):
    return all_moves(Tables(spark, sf)).select(
        "cik", "report_date", "cusip", "put_call", "move", "prev_shares", "curr_shares",
        money("prev_value"), money("curr_value"), ratio("curr_weight"), ratio("share_change_pct"))


def j2_moves_with_gaps(spark, sf):
    t = Tables(spark, sf)
    out = t.moves(weights=False, flawed=True)
    return moves.move_counts(out, "cik", "report_date")


def j3_latest_diff(spark, sf):
    """Moves between the two newest resolved quarters of every fund that has two."""
    t = Tables(spark, sf)
    two = holdings.latest_portfolios(t.chain(), 2)
    snap = holdings.snapshot(t.holdings(), two)
    newest = two.filter("recency = 1 and prev_report_date is not null").select("cik", "report_date")
    return moves.quarter_moves(snap).join(newest, ["cik", "report_date"], "left_semi").select(
        "cik", "report_date", "cusip", "put_call", "move", "prev_shares", "curr_shares")


def a3_consensus_holdings(spark, sf):
    t = Tables(spark, sf)
    out = consensus.consensus_holdings(t.snapshots(weights=False), t.funds(), 3)
    return out.select("report_date", "cusip", "ticker", "issuer", "n_funds", money("total_value"),
                      F.array_join("funds", ",").alias("funds"))


def a4_consensus_buys(spark, sf):
    t = Tables(spark, sf)
    out = consensus.consensus_moves(t.moves(weights=False), t.funds())
    vote = F.transform("votes", lambda v: F.concat_ws(":", v["label"], v["move"]))
    return out.select("report_date", "cusip", "ticker", "issuer", "n_funds", F.array_join(vote, ",").alias("votes"))


def a4_consensus_sells(spark, sf):
    t = Tables(spark, sf)
    out = consensus.consensus_moves(t.moves(weights=False), t.funds(), moves.SELLS, 2)
    return out.select("report_date", "cusip", "n_funds")


def l3_consensus_order(spark, sf):
    """Buys of the flagship screen in presentation order, with the rank as a column."""
    t = Tables(spark, sf)
    out = consensus.consensus_holdings(t.snapshots(weights=False), t.funds(), 3)
    from pyspark.sql import Window
    order = Window.partitionBy("report_date").orderBy(F.col("n_funds").desc(), F.round("total_value", 2).desc(), "cusip")
    return out.withColumn("place", F.row_number().over(order).cast("long")).select(
        "report_date", "place", "cusip", "n_funds").orderBy("report_date", "place")


def a5_coverage(spark, sf):
    t = Tables(spark, sf)
    out = consensus.coverage(t.snapshots(weights=False), t.funds())
    return out.select("cik", "fund", "report_date", "n", "n_res", money("val"), money("val_res"),
                      ratio("value_share"), money("value_unresolved"))


def a6_unresolved_tail(spark, sf):
    out = consensus.unresolved_tail(Tables(spark, sf).snapshots(weights=False))
    return out.select("cusip", "issuer", money("value"), "n_funds")


def a11_move_counts(spark, sf):
    out = Tables(spark, sf).moves(weights=False)
    return moves.move_counts(out, "cik", "report_date")


def a11_ticker_summary(spark, sf):
    out = Tables(spark, sf).moves(weights=False)
    return moves.ticker_summary(out.filter("ticker is not null"), "report_date", "ticker").withColumn(
        "total_value_usd", F.round("total_value_usd", 2))


def j16_compare_funds(spark, sf):
    """Overlap of the twelve largest funds in the newest quarter."""
    t = Tables(spark, sf)
    snap = t.snapshots()
    newest = t.chain()
    last = newest.agg(F.max("report_date").alias("d"))
    now = snap.filter(F.col("report_date") == last.scalar())
    top = newest.filter(F.col("report_date") == last.scalar()).orderBy(F.round("total_value", 2).desc(), "cik").limit(12)
    out = consensus.compare_funds(now, top)
    return out.select("cik_a", "cik_b", "n_a", "n_b", "common", ratio("common_weight"), ratio("jaccard"))


def j19_holders(spark, sf):
    t = Tables(spark, sf)
    out = consensus.holders(t.snapshots(), t.funds(), "ticker")
    return out.select("report_date", "cusip", "ticker", "cik", "fund", money("value_usd"), "shares", ratio("weight"))


def l1_top_positions(spark, sf):
    out = holdings.top_positions(Tables(spark, sf).snapshots().withColumn("value_usd", F.round("value_usd", 2)), 5)
    return out.select("accession", F.col("position_rank").cast("long").alias("position_rank"), "cusip", "put_call", "value_usd")


def l2_moves_by_size(spark, sf):
    m = all_moves(Tables(spark, sf))
    m = m.withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn(
        "share_change_pct", F.round("share_change_pct", 9))
    out = moves.rank_moves(m, "cik", "report_date")
    return out.select("cik", "report_date", "move", F.col("move_rank").cast("long").alias("move_rank"), "cusip", "put_call")


def w16_top_moves(spark, sf):
    """Top three of each move class per fund and quarter, HOLD left out, with the text."""
    m = all_moves(Tables(spark, sf)).filter("move <> 'HOLD'")
    m = m.withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn(
        "share_change_pct", F.round("share_change_pct", 9))
    out = moves.rank_moves(m, "cik", "report_date").filter("move_rank <= 3")
    return out.select("cik", "report_date", "move", F.col("move_rank").cast("long").alias("move_rank"),
                      "cusip", "put_call", moves.move_detail().alias("detail"))


def p3_long_only(spark, sf):
    out = Tables(spark, sf).snapshots(weights=False).filter("put_call = ''")
    return out.groupBy("report_date").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def p4_fund_set_filter(spark, sf):
    """Quarter totals for a fund set (the funds of the largest nation), beside all and none."""
    t = Tables(spark, sf)
    s = t.read("supplier")
    nation = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max(F.struct("n", "s_nationkey"))["s_nationkey"].alias("k"))
    chosen = s.filter(F.col("s_nationkey") == nation.scalar()).select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"))
    r = t.chain()
    count = lambda label, ciks: consensus.restrict_funds(r, ciks).groupBy("report_date").agg(
        F.count(F.lit(1)).alias("filings"), F.sum("n_positions").alias("positions")).withColumn("funds", F.lit(label))
    return count("all", None).unionByName(count("chosen", chosen)).unionByName(count("none", chosen.limit(0)))


def p5_quarter_range(spark, sf):
    t = Tables(spark, sf)
    lines = t.lines().filter(F.col("report_date").between(F.lit("2023-03-31").cast("date"), F.lit("2024-12-31").cast("date")))
    return t.resolved(lines).select("cik", "report_date", "accession")


def p1_value_units(spark, sf):
    t = Tables(spark, sf)
    m = holdings.value_multiplier("filing_date", "report_date")
    return t.lines().groupBy("report_date", "form", m.alias("multiplier")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * m), 2).alias("value_usd"))


def p2_blank_cusips(spark, sf):
    """Lines with a blanked security id are left out of positions."""
    t = Tables(spark, sf)
    blank = t.lines().withColumn("cusip", F.when(F.col("title_of_class") == "PROMO", "  ").otherwise(F.col("cusip")))
    return t.filings(blank).select("accession", "n_positions", money("total_value"))


def o2_union_of_keys(spark, sf):
    """Security keys seen in either of two adjacent quarters of a fund."""
    m = Tables(spark, sf).moves(weights=False)
    return m.groupBy("cik", "report_date").agg(F.count(F.lit(1)).alias("n_keys"))


def o5_distinct_sets(spark, sf):
    t = Tables(spark, sf)
    snap = t.snapshots(weights=False)
    quarters = snap.select(F.lit("quarter").alias("kind"), F.col("report_date").cast("string").alias("value")).distinct()
    tickers = snap.filter("ticker is not null").select(F.lit("ticker").alias("kind"), F.col("ticker").alias("value")).distinct()
    return quarters.unionByName(tickers)


QUERIES = {f.__name__: f for f in (
    a1_portfolio_positions, a2_filing_totals, a3_consensus_holdings, a4_consensus_buys,
    a4_consensus_sells, a5_coverage, a6_unresolved_tail, a11_move_counts, a11_ticker_summary,
    j1_snapshot_join, j2_quarter_moves, j2_moves_with_gaps, j3_latest_diff, j16_compare_funds,
    j19_holders, l1_top_positions, l2_moves_by_size, l3_consensus_order, o2_union_of_keys,
    o5_distinct_sets, p1_value_units, p2_blank_cusips, p3_long_only, p4_fund_set_filter,
    p5_quarter_range, p7_preferred_filings, p8_latest_originals, w1_resolved_filings,
    w2_position_weights, w3_previous_quarter, w6_latest_per_fund, w7_latest_portfolios,
    w10_conviction_timeline, w11_value_timeline, w16_top_moves,
)}

"""Registered queries on insider activity, the score and the feature table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import score as scoring
from tidemark.functions import texts, values
from tidemark.operators import insider, quality
from tidemark.params import EXPORT_COLUMNS, FORM4_WINDOW_DAYS, PRECOMPUTE_WINDOWS
from tidemark.plans import features as feat
from tidemark.plans.driver_tables import Tables
from tidemark.plans.filing_queries import money, ratio
from tidemark.session import materialize

AS_OF = "2026-06-30"


def _quarter_points(t: Tables):
    """Every ticker at every quarter end of the trade history."""
    q = F.last_day(F.add_months(F.trunc("transaction_date", "quarter"), 2))
    return t.trades().select("ticker", q.alias("as_of")).distinct()


def _activity_columns():
    return [F.col(c).cast("long").alias(c) for c in (
        "n_visible", "n_buyers", "n_sellers", "n_c_suite_buyers", "recent_cluster_n", "days_since_last_buy")] + [
        money("buy_value_usd"), money("sell_value_usd"), F.round("conviction_units", 4).alias("conviction_units"),
        money("recency_weighted_buy_usd"), F.round("max_stake_increase_pct", 4).alias("max_stake_increase_pct")]


def a7_insider_activity(spark, sf):
    t = Tables(spark, sf)
    out = insider.insider_activity(t.trades(), _quarter_points(t))
    return out.select("ticker", "as_of", *_activity_columns())


def j9_visible_trades(spark, sf):
    """How many trades each (ticker, quarter end) may see, and how many filings."""
    t = Tables(spark, sf)
    trades, points = t.trades(), _quarter_points(t)
    rows = insider.visible_at(insider.fold_trades(trades), points).groupBy("ticker", "as_of").agg(
        F.sum("n_rows").alias("n_trades"))
    filings = insider.visible_accessions(trades, points).groupBy("ticker", "as_of").agg(F.count(F.lit(1)).alias("n_filings"))
    return rows.join(filings, ["ticker", "as_of"])


def p12_open_market_trades(spark, sf):
    t = Tables(spark, sf).trades()
    return t.groupBy("ticker").agg(
        F.count_if(insider.is_buy()).alias("n_buys"), F.count_if(insider.is_sell()).alias("n_sells"),
        F.count(F.lit(1)).alias("n"))


def p14_trade_date_window(spark, sf):
    """Trades filed and made inside a window."""
    low, high = F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date")
    t = Tables(spark, sf).trades().filter(F.col("filing_date").between(low, high) & F.col("transaction_date").between(low, high))
    return t.groupBy("ticker", "transaction_code").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


def st14_trailing_cluster(spark, sf):
    """Distinct buyers in the 14 days up to every quarter end (the recent cluster)."""
    t = Tables(spark, sf)
    vis = insider.visible_at(insider.fold_trades(t.trades()), _quarter_points(t), 14)
    return vis.filter("n_buys > 0").groupBy("ticker", "as_of").agg(F.count_distinct("owner").alias("recent_buyers"))


def f3_f8_owner_roles(spark, sf):
    """C-suite test, role label and seniority multiplier per customer segment."""
    t = Tables(spark, sf).trades()
    c = texts.is_c_suite(F.col("is_officer"), F.col("officer_title"))
    role = texts.role_label(F.col("is_officer"), F.col("is_director"), F.col("is_ten_percent_owner"), F.col("officer_title"))
    mult = values.seniority_multiplier(c, F.col("is_officer"), F.col("is_ten_percent_owner"))
    return t.groupBy(c.alias("c_suite"), role.alias("role"), mult.alias("seniority")).agg(F.count(F.lit(1)).alias("n"))


def f5_f7_curves(spark, sf):
    """Saturation, recency, stake and sizing curves over order lines."""
    l = Tables(spark, sf).read("lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    stake = values.stake_increase(q, q * (1 + F.col("l_linenumber") * 3) - 1)
    signed = F.when(F.col("l_linenumber") % 2 == 0, -q).otherwise(q)
    return l.groupBy("l_quantity", "l_linenumber").agg(F.max("l_discount").alias("l_discount")).select(
        "l_quantity", "l_linenumber",
        F.round(values.saturating(q - 10, 1.5), 9).alias("saturating"),
        F.round(values.signed_saturating(signed, 3.0), 9).alias("signed"),
        F.round(values.recency(q - 5, 30.0), 9).alias("recency"),
        F.round(stake, 9).alias("stake"),
        F.round(values.sizing_multiplier(stake), 9).alias("sizing"),
    )


def f11_trade_value(spark, sf):
    t = Tables(spark, sf).trades()
    v = values.trade_value(F.col("shares"), F.col("price_per_share"))
    return t.groupBy("ticker").agg(F.round(F.sum(v), 2).alias("value_usd"))


def _features(t: Tables, trades=True):
    t.keep_line_parts()
    m = t.moves(by_fund=True)
    return m, feat.build_features(m, t.trades() if trades else None, t.stored_prices())


def a8_institutional_signals(spark, sf):
    out = feat.institutional_signals(Tables(spark, sf).moves())
    return out.select("report_date", "ticker", "as_of", "issuer_name", "funds_accumulating", "funds_trimming",
                      money("total_value_usd"), ratio("avg_weight_pct"), "conviction_funds", "n_moves")


def _scored_columns():
    return [F.round(c, 6).alias(c) for c in ("score", "institutional_score", "insider_score", "dollar_score",
            "agreement_score", "penalty_score", "x", "y")]


def f9_score_pillars(spark, sf):
    _, f = _features(Tables(spark, sf))
    return f.select("report_date", "ticker", *_scored_columns())


def f10_quadrants(spark, sf):
    _, f = _features(Tables(spark, sf))
    return f.select("report_date", "ticker", "quadrant", scoring.quadrant_label(F.col("quadrant")).alias("label"),
                    scoring.rationale(F.col("quadrant")).alias("rationale"))


def _latest_sides(t: Tables, days: int = FORM4_WINDOW_DAYS):
    """Fund side of the signal quarter, and insider side at a date: trades that can be seen then and
    are at most ``days`` old, chosen before they are joined and folded."""
    m = t.moves()
    quarter = quality.signal_quarter(t.chain())
    signals = feat.institutional_signals(m).filter(F.col("report_date") == quarter.scalar()).drop("as_of")
    trades = t.trades()
    as_of = F.lit(AS_OF).cast("date")
    trades = trades.filter((F.col("transaction_date") >= F.date_sub(as_of, days)) & (F.col("filing_date") <= as_of))
    points = trades.select("ticker").distinct().withColumn("as_of", as_of)
    return signals, trades, points


def j5_score_table(spark, sf):
    signals, trades, points = _latest_sides(Tables(spark, sf))
    out = feat.score_table(signals, insider.insider_activity(trades, points).drop("as_of"))
    return out.select("ticker", "quadrant", "funds_accumulating", F.col("n_buyers").cast("long").alias("n_buyers"), *_scored_columns())


def p11_min_score_filter(spark, sf):
    """Score floor, kept inside 0..100 whatever is asked for."""
    signals, trades, points = _latest_sides(Tables(spark, sf))
    scored = feat.score_table(signals, insider.insider_activity(trades, points).drop("as_of"))
    floors = F.explode(F.array(*[F.lit(str(low)) for low in (-5, 70, 900)]))
    asked = scored.select(floors.alias("floor"), "ticker", "score")
    kept = F.col("score") >= F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("floor").cast("double")))
    return asked.filter(kept).select("floor", "ticker", F.round("score", 6).alias("score"))


def l6_signals_by_score(spark, sf):
    signals, trades, points = _latest_sides(Tables(spark, sf))
    out = feat.score_table(signals, insider.insider_activity(trades, points).drop("as_of"))
    return out.select("ticker", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "ticker")


def k11_score_windows(spark, sf):
    signals, trades, _ = _latest_sides(Tables(spark, sf), max(PRECOMPUTE_WINDOWS))
    out = feat.precompute_scores(signals, trades, F.lit(AS_OF).cast("date"))
    return out.select("window_days", "ticker", "quadrant", F.col("n_buyers").cast("long").alias("n_buyers"), *_scored_columns())


def a12_score_kpis(spark, sf):
    signals, trades, _ = _latest_sides(Tables(spark, sf), max(PRECOMPUTE_WINDOWS))
    return feat.score_kpis(feat.precompute_scores(signals, trades, F.lit(AS_OF).cast("date")), "window_days")


def f28_signal_records(spark, sf):
    """The nested record flattened again: buyers in order and rounded numbers."""
    signals, trades, points = _latest_sides(Tables(spark, sf))
    owners = insider.owner_activity(insider.visible_at(insider.fold_trades(trades), points))
    scored = feat.score_table(signals, insider.ticker_activity(owners).drop("as_of"))
    rec = feat.signal_record(scored, insider.buyer_rows(owners))
    b = F.transform("insider.buyers", lambda x: F.concat_ws(":", x["name"], x["role"], x["days_since_last_buy"].cast("string")))
    return rec.select("ticker", "score", "quadrant_label", "x", "y", F.col("breakdown.agreement_score").alias("agreement"),
                      F.col("institutional.avg_weight_pct").alias("avg_weight_pct"),
                      F.col("insider.conviction_units").alias("conviction_units"), F.array_join(b, ",").alias("buyers"))


def u3_score_provider(spark, sf):
    """A caller may supply both sides itself: here order totals stand in for insider dollars."""
    t = Tables(spark, sf)
    signals, _, _ = _latest_sides(t)
    c = t.read("customer")
    own = c.groupBy(F.concat(F.lit("T"), F.translate((F.col("c_custkey") % 30 + 1).cast("string"), "0123456789", "ABCDEFGHIJ")).alias("ticker")).agg(
        F.count(F.lit(1)).alias("n_buyers"), F.round(F.sum("c_acctbal"), 2).alias("recency_weighted_buy_usd"),
        F.round(F.sum("c_acctbal"), 2).alias("buy_value_usd"), F.lit(2.0).alias("conviction_units"), F.lit(10).alias("days_since_last_buy"))
    return feat.score_table(signals, own).select("ticker", "quadrant", *_scored_columns())


def v4_feature_table(spark, sf):
    _, f = _features(Tables(spark, sf))
    return f.select(
        "report_date", "ticker", "as_of", "feature_scope", "split", "quadrant", "data_quality_flags",
        F.round("score", 6).alias("score"), "funds_accumulating", "funds_trimming", "net_funds", "conviction_funds",
        ratio("avg_weight_pct"), money("total_value_usd"), F.col("n_buyers").cast("long").alias("open_market_buyers"),
        money("buy_value_usd"), "execution_timestamp", "adjusted_entry_price", "adjusted_exit_price",
        "forward_return_20d", "forward_return_60d", "forward_return_120d")


def v4_features_without_trades(spark, sf):
    _, f = _features(Tables(spark, sf), trades=False)
    return f.select("report_date", "ticker", "feature_scope", "data_quality_flags", "quadrant", F.round("score", 6).alias("score"))


def p10_universe_restriction(spark, sf):
    """Signals restricted to the tickers that have a price on the last price day."""
    t = Tables(spark, sf)
    prices = t.prices()
    last = prices.agg(F.max("date").alias("d"))
    universe = prices.filter(F.col("date") == last.scalar()).select("ticker")
    out = feat.institutional_signals(t.moves(), universe=universe)
    return out.select("report_date", "ticker", "funds_accumulating", "funds_trimming")


def _export(t: Tables):
    # Signals and both lists of the lineage read the moves, so they are made once: what is read of long positions with a ticker.
    # They are dealt out by fund there, so funds are met before they are written.
    t.keep_line_parts()
    m = t.moves(by_fund=True).filter("put_call = '' and coalesce(ticker, '') <> ''").select(
        "cik", "report_date", "cusip", "put_call", "ticker", "issuer", "title_of_class", "move", "curr_value", "curr_weight", "filing_date", "accession")
    m = materialize(feat.with_funds(m, t.funds()), "moves")
    f = materialize(feat.build_features(m, t.trades(), t.stored_prices()), "features")
    return feat.export_features(f, m, None, t.trades(), price_source="local", priced=t.stored_prices(), code_commit="test")


def k9_export_rows(spark, sf):
    out = _export(Tables(spark, sf))
    return out.select("report_date", "ticker", "issuer_name", "score", "fund_moves", "price_source", "feature_scope",
                      "market_cap", "open_market_buyers", "forward_return_60d")


def k13_version_stamps(spark, sf):
    t = Tables(spark, sf)
    out = feat.stamp(feat.institutional_signals(t.moves()), "test")
    return out.groupBy("score_version", "feature_schema_version", "weight_version", "parameter_hash", "code_commit").agg(
        F.count(F.lit(1)).alias("n"))


def a30_accession_hashes(spark, sf):
    out = _export(Tables(spark, sf))
    return out.select("report_date", "ticker", F.col("13f_accession_hash").alias("filings_hash"),
                      F.col("form4_accession_hash").alias("trades_hash"))


def o6_accession_sets(spark, sf):
    out = _export(Tables(spark, sf))
    return out.select("report_date", "ticker", F.col("13f_accessions").alias("filings"), F.col("form4_accessions").alias("trades"))


def j18_refresh_cached_scores(spark, sf):
    """Cached records with stale fund fields, refilled from the filings; other fields stay."""
    t = Tables(spark, sf)
    signals, _, _ = _latest_sides(t)
    cached = t.fundamentals().select("ticker", F.lit(50.0).alias("score"), F.lit(0.0).alias("total_value_usd"),
                                     F.lit(0).cast("long").alias("conviction_funds"))
    fresh = signals.select("ticker", F.col("total_value_usd").alias("_v"), F.col("conviction_funds").alias("_c"))
    out = cached.join(fresh, "ticker", "left")
    return out.select("ticker", "score", F.round(F.coalesce("_v", "total_value_usd"), 2).alias("total_value_usd"),
                      F.coalesce("_c", "conviction_funds").alias("conviction_funds"), F.col("_v").isNotNull().alias("enriched"))


QUERIES = {f.__name__: f for f in (
    a7_insider_activity, j9_visible_trades, p12_open_market_trades, p14_trade_date_window, st14_trailing_cluster,
    f3_f8_owner_roles, f5_f7_curves, f11_trade_value, a8_institutional_signals, f9_score_pillars,
    f10_quadrants, j5_score_table, p11_min_score_filter, l6_signals_by_score, k11_score_windows,
    a12_score_kpis, f28_signal_records, u3_score_provider, v4_feature_table, v4_features_without_trades,
    p10_universe_restriction, k9_export_rows, k13_version_stamps, a30_accession_hashes, o6_accession_sets,
    j18_refresh_cached_scores,
)}

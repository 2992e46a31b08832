"""The point-in-time feature table and the score table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import score as scoring
from tidemark.functions.texts import list_hash, ticker_problems
from tidemark.functions.values import split_of, text
from tidemark.operators import insider, pricing
from tidemark.operators.digests import list_digests
from tidemark.params import (
    CONVICTION_WEIGHT, EXPORT_COLUMNS, FEATURE_SCHEMA_VERSION, FORM4_WINDOW_DAYS, PARAMETER_HASH,
    PRECOMPUTE_WINDOWS, SCOPE_13F_ONLY, SCOPE_JOINED, SCORE_VERSION, WEIGHT_VERSION,
)

from tidemark.session import materialize


def institutional_signals(moves: DataFrame, include_non_priceable: bool = False,
                          universe: DataFrame | None = None) -> DataFrame:
    """Fund side of the score per (quarter, ticker). Positions are counted, not funds: two
    share classes of a ticker in one fund count twice. ``as_of`` is the newest filing date
    among the funds with any move on the ticker, HOLD included."""
    long = moves.filter((F.col("put_call") == "") & (F.coalesce("ticker", F.lit("")) != "")).withColumn(
        "ticker", F.upper("ticker")
    )
    if universe is not None:
        long = long.join(universe.select("ticker").distinct(), "ticker", "left_semi")
    # A blank ticker has no flag of these, and no price either.
    problems, blank = ticker_problems("ticker", "title_of_class"), text("ticker") == ""
    if not include_non_priceable:
        long = long.filter(~reduce(or_, problems.values(), blank))
        problems = {}
    buys, sells = F.col("move").isin("NEW", "ADD"), F.col("move").isin("EXIT", "TRIM")
    convinced = (F.col("move") == "NEW") | (F.col("curr_weight") >= CONVICTION_WEIGHT)
    named = F.when(F.coalesce("issuer", F.lit("")) != "", F.struct("cik", "cusip", "issuer"))
    flags = [F.when(F.bool_or(test & ~blank), F.lit(name)) for name, test in problems.items()]
    return long.groupBy("report_date", "ticker").agg(
        F.max("filing_date").alias("as_of"),
        F.min(named)["issuer"].alias("issuer_name"),
        F.count_if(buys).alias("funds_accumulating"),
        F.count_if(sells).alias("funds_trimming"),
        F.sum(F.when(buys, F.col("curr_value")).otherwise(0.0)).alias("total_value_usd"),
        F.coalesce(F.avg(F.when(buys, F.col("curr_weight"))) * 100.0, F.lit(0.0)).alias("avg_weight_pct"),
        F.count_if(buys & convinced).alias("conviction_funds"),
        (F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")).alias("quality_flags"),
        F.count(F.lit(1)).alias("n_moves"),
    )


def with_funds(moves: DataFrame, funds: DataFrame) -> DataFrame:
    """Moves with the ``listings`` of their fund, null for a fund that is not listed."""
    return moves.join(funds.groupBy("cik").agg(F.collect_list(F.struct("label")).alias("listings")), "cik", "left")


def filing_lineage(moves: DataFrame, signals: DataFrame, funds: DataFrame | None) -> DataFrame:
    """Per (quarter, ticker): fund labels and moves in cik order, and the sorted distinct
    filings behind them with their hash. Entries stay rows until their texts are put together.
    Without ``funds`` the moves come from ``with_funds``."""
    key = ["report_date", "ticker"]
    long = moves if funds is None else with_funds(moves, funds)
    long = long.filter("listings is not null and put_call = '' and coalesce(ticker, '') <> ''").withColumn("ticker", F.upper("ticker"))
    long = long.join(signals.select(*key), key, "left_semi").withColumn("label", F.explode("listings.label"))
    who = list_digests(long, key, "cik", ["cik", "cusip", "label", "move"], distinct=False, texts={"fund_labels": "label", "fund_moves": "move"})
    filed = list_digests(long, key, "accession", texts={"13f_accessions": lambda a: F.nullif(a, F.lit(""))}, combine=False)
    return who.drop("n", "digest").join(filed.drop("n").withColumnRenamed("digest", "13f_accession_hash"), key, "left")


def build_features(moves: DataFrame, trades: DataFrame | None = None, prices: DataFrame | None = None,
                   window_days: int = FORM4_WINDOW_DAYS, execution_lag: int = 1,
                   include_non_priceable: bool = False, universe: DataFrame | None = None) -> DataFrame:
    """Score and forward returns of every (quarter, ticker), using only what was filed by
    then. Lists of filings are added by ``export_features``."""
    # One row per quarter and ticker, read three times below: written once.
    signals = materialize(institutional_signals(moves, include_non_priceable, universe), "signals")
    points = signals.select("ticker", "as_of")
    out = signals
    if trades is not None:
        out = out.join(insider.insider_activity(trades, points, window_days), ["ticker", "as_of"], "left")
    out = scoring.add_score(out)
    if prices is not None:
        returns = pricing.forward_returns(points, prices, execution_lag)
        out = out.join(returns, ["ticker", "as_of"], "left")
    else:
        out = out.withColumns({
            "execution_timestamp": F.lit(None).cast("date"),
            **{c: F.lit(None).cast("double") for c in (
                "adjusted_entry_price", "adjusted_exit_price", "forward_return_20d",
                "forward_return_60d", "forward_return_120d")},
        })
    if trades is None:
        extra, scope = F.array(F.lit("insider_features_not_joined")), SCOPE_13F_ONLY
        out = out.withColumn("n_visible", F.lit(0).cast("long"))
    else:
        seen = F.coalesce("n_visible", F.lit(0)) > 0
        extra = F.when(seen, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_form4_activity_in_window")))
        scope = SCOPE_JOINED
    return out.withColumns({
        "feature_scope": F.lit(scope),
        "data_quality_flags": F.array_join(F.array_sort(F.array_union("quality_flags", extra)), ";"),
        "split": split_of(F.col("as_of")),
    })


def stamp(df: DataFrame, code_commit: str = "unknown") -> DataFrame:
    """Score, schema and weight versions and the parameter hash on every row."""
    return df.withColumns({
        "score_version": F.lit(SCORE_VERSION),
        "feature_schema_version": F.lit(FEATURE_SCHEMA_VERSION),
        "weight_version": F.lit(WEIGHT_VERSION),
        "parameter_hash": F.lit(PARAMETER_HASH),
        "code_commit": F.lit(code_commit),
    })


def export_features(features: DataFrame, moves: DataFrame, funds: DataFrame | None, trades: DataFrame | None = None,
                    window_days: int = FORM4_WINDOW_DAYS, price_source: str = "",
                    priced: DataFrame | None = None, code_commit: str = "unknown") -> DataFrame:
    """The feature table in the file layout: fixed columns, rounded, with filing lists."""
    out, source = features, F.lit("")
    if priced is not None:  # before the long texts, which move less often then
        out = out.join(priced.select("ticker").distinct().withColumn("_p", F.lit(True)), "ticker", "left")
        source = F.when(F.col("_p"), price_source).otherwise("")
    out = out.join(filing_lineage(moves, features, funds), ["report_date", "ticker"], "left")
    if trades is None:
        out = out.withColumns({"_hash": F.lit(None).cast("string"), "_list": F.lit(None).cast("string")})
    else:
        # A filing has few trades, so its copies are folded where its key is.
        visible = insider.visible_filings(trades, features.select("ticker", "as_of"), window_days)
        lists = list_digests(visible, ["ticker", "as_of"], "accession", texts={"_list": "accession"}, combine=False)
        # The long texts take on the short key of the other lists, so they move once.
        lists = lists.drop("n").withColumnRenamed("digest", "_hash").join(features.select("report_date", "ticker", "as_of"), ["ticker", "as_of"])
        out = out.join(lists.drop("as_of"), ["report_date", "ticker"], "left")
    blank = F.lit("")
    out = stamp(out, code_commit).withColumns({
        "issuer_name": F.coalesce("issuer_name", blank),
        "score": F.round("score", 6),
        "institutional_score": F.round("institutional_score", 6),
        "insider_score": F.round("insider_score", 6),
        "avg_weight_pct": F.round("avg_weight_pct", 6),
        "total_value_usd": F.round("total_value_usd", 2),
        "open_market_buyers": F.col("n_buyers"),
        "open_market_buy_value_usd": F.round("buy_value_usd", 2),
        "form4_accession_hash": F.coalesce("_hash", list_hash(F.array().cast("array<string>"))),
        "form4_accessions": F.coalesce("_list", blank),
        "price_source": source,
        **{c: blank for c in ("dollar_volume", "market_cap", "sector", "beta")},
    })
    return out.select(*EXPORT_COLUMNS)


def score_table(signals: DataFrame, activity: DataFrame, min_score: float = 0.0,
                keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Both sides joined on the key, a missing side counting as neutral, scored and
    filtered."""
    joined = signals.join(activity, list(keys), "full_outer")
    low = max(0.0, min(100.0, float(min_score)))
    return scoring.add_score(joined).filter(F.col("score") >= low)


def precompute_scores(signals: DataFrame, trades: DataFrame, as_of: Column,
                      windows: tuple[int, ...] = PRECOMPUTE_WINDOWS) -> DataFrame:
    """Score table for several insider windows at once, keyed by ``window_days``."""
    tickers = signals.select("ticker").unionByName(trades.select("ticker")).distinct()
    points = tickers.withColumn("as_of", as_of)
    activity = insider.activity_by_window(trades, points, windows).drop("as_of")
    per_window = signals.withColumn("window_days", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
    return score_table(per_window, activity, keys=("ticker", "window_days"))


def score_kpis(scored: DataFrame, *keys: str) -> DataFrame:
    """Headline numbers of a score table."""
    top = F.max(F.struct(F.round("score", 6).alias("s"), F.col("ticker")))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.count_if(F.col("quadrant") == "conviction").alias("n_conviction"),
        F.count_if((F.col("n_c_suite_buyers") > 0) & (F.col("n_buyers") >= 2)).alias("n_csuite_clusters"),
        top["ticker"].alias("top_ticker"),
        F.round(top["s"], 1).alias("top_score"),
        F.round(F.sum("buy_value_usd"), 2).alias("insider_buy_usd"),
    )


def signal_record(scored: DataFrame, buyers: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The nested published record, with rounded numbers and buyers by dollars."""
    r = lambda c, n: F.round(c, n).alias(c)
    entry = F.struct(
        (-F.col("value_usd")).alias("_order"), "name", "role", "is_c_suite", r("value_usd", 2),
        "stake_increase_pct", "days_since_last_buy",
    )
    lists = buyers.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    out = scored.join(lists, list(keys), "left")
    return out.select(
        *keys, r("score", 1), "quadrant", scoring.quadrant_label(F.col("quadrant")).alias("quadrant_label"),
        scoring.rationale(F.col("quadrant")).alias("rationale"), r("x", 4), r("y", 4),
        F.struct(*[F.round(c, 1).alias(c) for c in (
            "institutional_score", "insider_score", "dollar_score", "agreement_score", "penalty_score")]).alias("breakdown"),
        F.struct("funds_accumulating", "funds_trimming", "net_funds", "conviction_funds",
                 r("avg_weight_pct", 2), "quarters_ago", r("total_value_usd", 2)).alias("institutional"),
        F.struct("n_buyers", "n_c_suite_buyers", (F.col("n_buyers") >= 2).alias("is_cluster"), "recent_cluster_n",
                 "days_since_last_buy", r("max_stake_increase_pct", 4), r("conviction_units", 3),
                 r("buy_value_usd", 2), r("recency_weighted_buy_usd", 2), r("sell_value_usd", 2),
                 F.transform(F.coalesce("_b", F.array()), lambda b: b.dropFields("_order")).alias("buyers")).alias("insider"),
    )

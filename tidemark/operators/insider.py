"""Insider trades: activity per ticker, what was visible at a date, and file checks.

Trades are folded to one row per (ticker, owner, filing day, trade day) before they
meet the dates they are asked for. The age decay of a trade depends only on its day, so
it can be applied to the folded row without changing the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.texts import is_c_suite, pad_cik, role_label
from tidemark.functions.values import (
    lenient_date, recency, seniority_multiplier, sizing_multiplier, stake_increase, text, trade_value,
)
from tidemark.params import DEFAULT_FEATURES, FORM4_ROW_KEY, FORM4_WINDOW_DAYS, FeatureParams


def is_buy() -> Column:
    return (F.col("transaction_code") == "P") & (F.col("acquired_disposed") == "A")


def is_sell() -> Column:
    return (F.col("transaction_code") == "S") & (F.col("acquired_disposed") == "D")


def _kind(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _prepared(trades: DataFrame, p: FeatureParams) -> DataFrame:
    c_suite = is_c_suite(F.col("is_officer"), F.col("officer_title"))
    stake = stake_increase(F.col("shares"), F.col("shares_owned_after"))
    weight = sizing_multiplier(stake, p) * seniority_multiplier(
        c_suite, F.col("is_officer"), F.col("is_ten_percent_owner"), p
    )
    return trades.withColumns(
        {
            "owner": F.coalesce(F.nullif("owner_cik", F.lit("")), "owner_name"),
            "buy": _kind(is_buy()),
            "sell": _kind(is_sell()),
            "value": trade_value(F.col("shares"), F.col("price_per_share")),
            "stake": F.coalesce(stake, F.lit(0.0)),
            "weight": weight,
            "who": F.struct(
                F.col("owner_name").alias("name"),
                role_label(F.col("is_officer"), F.col("is_director"), F.col("is_ten_percent_owner"),
                           F.col("officer_title")).alias("role"),
                c_suite.alias("is_c_suite"),
            ),
        }
    )


def trades_by_owner(trades: DataFrame, p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """The columns of ``fold_trades`` with a row per trade, dealt out by (ticker, owner): an owner rarely
    trades twice a day, so rows are summed once, per owner and date asked for, where they are."""
    when = lambda flag, c, name: F.when(F.col(flag), c).alias(name)
    # Only purchases and sales take their figures along, and only those that are read later.
    order = F.struct("accession", "who")
    dealt = _prepared(trades, p).select(
        "ticker", "owner", "filing_date", "transaction_date", "issuer_name", "buy", "sell",
        when("buy", F.col("shares"), "buy_shares"), when("buy", F.col("value"), "buy_value"), when("buy", F.col("weight"), "buy_weight"),
        when("buy", F.col("stake"), "buy_stake"), when("sell", F.col("shares"), "sell_shares"), when("sell", F.col("value"), "sell_value"),
        when("buy", order, "first_buy"), when("sell", order, "first_sell")).repartition("ticker", "owner")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return dealt.select(
        "ticker", "owner", "filing_date", "transaction_date", F.lit(1).cast("long").alias("n_rows"),
        F.col("buy").cast("long").alias("n_buys"), F.col("sell").cast("long").alias("n_sells"), zero("buy_shares"), zero("buy_value"),
        zero("buy_weight"), "buy_stake", zero("sell_shares"), zero("sell_value"), "first_buy", "first_sell", "issuer_name")


def fold_trades(trades: DataFrame, p: FeatureParams = DEFAULT_FEATURES, by_owner: bool = False) -> DataFrame:
    """One row per (ticker, owner, filing_date, transaction_date) with summed measures. ``by_owner``
    deals trades out by (ticker, owner) alone: what is folded per owner later need not move again."""
    prepared = _prepared(trades, p)
    only = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)).otherwise(0.0))
    order = F.struct("accession", "who")
    if by_owner:
        # Only purchases and sales take their figures along.
        deal = F.when(F.col("buy") | F.col("sell"), F.struct("shares", "value", "stake", "weight", order.alias("order")))
        keys = ["ticker", "owner", "filing_date", "transaction_date", "buy", "sell", "issuer_name"]
        prepared = prepared.select(*keys, deal.alias("deal")).repartition("ticker", "owner").select(*keys, "deal.*")
        order = F.col("order")
    return prepared.groupBy("ticker", "owner", "filing_date", "transaction_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("buy").alias("n_buys"),
        F.count_if("sell").alias("n_sells"),
        only("buy", "shares").alias("buy_shares"),
        only("buy", "value").alias("buy_value"),
        only("buy", "weight").alias("buy_weight"),
        F.max(F.when(F.col("buy"), F.col("stake"))).alias("buy_stake"),
        only("sell", "shares").alias("sell_shares"),
        only("sell", "value").alias("sell_value"),
        F.min(F.when(F.col("buy"), order)).alias("first_buy"),
        F.min(F.when(F.col("sell"), order)).alias("first_sell"),
        F.max("issuer_name").alias("issuer_name"),
    )


def visible_at(folded: DataFrame, points: DataFrame, window_days: int = FORM4_WINDOW_DAYS) -> DataFrame:
    """Folded trades that were filed by ``as_of`` and traded in the window before it, for
    each (ticker, as_of).

    The window is cut into slices of its own length, so a point asks for two slices and
    the join is an equi join on (ticker, slice): one ticker with very many trades spreads
    over its slices instead of meeting all its dates in one task.
    """
    days = max(1, int(window_days))
    epoch = F.lit("1970-01-01").cast("date")
    slice_of = lambda c: F.floor(F.datediff(c, epoch) / days)
    sliced = folded.filter("transaction_date is not null").withColumn("_slice", slice_of("transaction_date"))
    asked = points.select("ticker", "as_of").distinct().withColumn(
        "_slice", F.explode(F.array(slice_of("as_of"), slice_of("as_of") - 1))
    )
    return (
        asked.join(sliced, ["ticker", "_slice"])
        .filter(
            (F.col("filing_date").isNull() | (F.col("filing_date") <= F.col("as_of")))
            & (F.col("transaction_date") <= F.col("as_of"))
            & (F.col("transaction_date") >= F.date_sub("as_of", days))
        )
        .drop("_slice")
    )


def owner_activity(visible: DataFrame, window_days: int = FORM4_WINDOW_DAYS,
                   p: FeatureParams = DEFAULT_FEATURES, keys: tuple[str, ...] = ("ticker", "as_of"), dealt: bool = False) -> DataFrame:
    """One row per (keys, owner): what the owner bought and sold. Rows that are ``dealt`` out already are sorted
    by a hash of the key first, which is cheaper than by its texts."""
    # A trade without a date counts as old as the window reaches.
    age = F.when(F.col("transaction_date").isNull(), int(window_days)).otherwise(
        F.greatest(F.datediff("as_of", "transaction_date"), F.lit(0)))
    decay = recency(F.col("_age"), p.recency_halflife_days)
    bought = F.col("n_buys") > 0
    # An owner is described as in the first filing that shows the trade.
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("filing_date", c)))
    return (
        visible.withColumn("_age", age)
        .groupBy(*([F.xxhash64(*keys, "owner").alias("_key")] if dealt else []), *keys, "owner")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_buys").alias("n_buys"),
            F.sum("n_sells").alias("n_sells"),
            F.sum("buy_shares").alias("buy_shares"),
            F.sum("buy_value").alias("buy_value"),
            F.sum("sell_shares").alias("sell_shares"),
            F.sum("sell_value").alias("sell_value"),
            F.sum(F.when(bought, F.col("buy_weight") * decay).otherwise(0.0)).alias("units"),
            F.sum(F.when(bought, F.col("buy_value") * decay).otherwise(0.0)).alias("recent_usd"),
            F.max("buy_stake").alias("stake"),
            F.min(F.when(bought, F.col("_age"))).alias("last_buy_age"),
            first("first_buy").alias("fb"),
            first("first_sell").alias("fs"),
            F.max("issuer_name").alias("issuer_name"),
        )
        .withColumns({"buyer": F.col("fb.first_buy.who"), "seller": F.col("fs.first_sell.who")})
        .drop("fb", "fs", "_key")
    )


def ticker_activity(owners: DataFrame, p: FeatureParams = DEFAULT_FEATURES,
                    keys: tuple[str, ...] = ("ticker", "as_of")) -> DataFrame:
    """Insider side of the score per ``keys``."""
    buyer, seller = F.col("n_buys") > 0, F.col("n_sells") > 0
    return owners.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_visible"),
        F.count_if(buyer).alias("n_buyers"),
        F.count_if(seller).alias("n_sellers"),
        F.count_if(buyer & F.col("buyer.is_c_suite")).alias("n_c_suite_buyers"),
        F.sum("buy_value").alias("buy_value_usd"),
        F.sum("sell_value").alias("sell_value_usd"),
        F.round(F.sum("units"), 4).alias("conviction_units"),
        F.round(F.sum("recent_usd"), 2).alias("recency_weighted_buy_usd"),
        F.min("last_buy_age").alias("days_since_last_buy"),
        F.count_if(buyer & (F.col("last_buy_age") <= p.recent_window_days)).alias("recent_cluster_n"),
        F.round(F.coalesce(F.max("stake"), F.lit(0.0)), 4).alias("max_stake_increase_pct"),
        F.max("issuer_name").alias("insider_issuer_name"),
    )


def insider_activity(trades: DataFrame, points: DataFrame, window_days: int = FORM4_WINDOW_DAYS,
                     p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Point-in-time insider activity for each (ticker, as_of)."""
    visible = visible_at(trades_by_owner(trades, p), points, window_days)
    return ticker_activity(owner_activity(visible, window_days, p, dealt=True), p)


def activity_by_window(trades: DataFrame, points: DataFrame, windows: tuple[int, ...],
                       p: FeatureParams = DEFAULT_FEATURES) -> DataFrame:
    """Activity per (ticker, as_of, window_days) for several windows in one pass: trades of
    the widest window are fetched once and counted in every window they fall into."""
    visible = visible_at(fold_trades(trades, p), points, max(windows))
    age = F.datediff("as_of", "transaction_date")
    per_window = visible.withColumn(
        "window_days", F.explode(F.array(*[F.lit(int(w)) for w in windows]))
    ).filter(age <= F.col("window_days"))
    keys = ("ticker", "as_of", "window_days")
    return ticker_activity(owner_activity(per_window, max(windows), p, keys), p, keys)


def visible_filings(trades: DataFrame, points: DataFrame, window_days: int = FORM4_WINDOW_DAYS) -> DataFrame:
    """Insider filings visible for each (ticker, as_of), a row per trade of a filing."""
    slim = trades.select("ticker", "accession", "filing_date", "transaction_date").filter("accession <> ''")
    return visible_at(slim, points, window_days).select("ticker", "as_of", "accession")


def visible_accessions(trades: DataFrame, points: DataFrame,
                       window_days: int = FORM4_WINDOW_DAYS) -> DataFrame:
    """Distinct insider filings visible for each (ticker, as_of), one per row."""
    return visible_filings(trades, points, window_days).distinct()


def buyer_rows(owners: DataFrame) -> DataFrame:
    """Buyers of each (ticker, as_of) as rows, largest dollars first."""
    return owners.filter("n_buys > 0").select(
        "ticker", "as_of",
        F.col("owner").alias("owner_key"),
        F.col("buyer.name").alias("name"),
        F.col("buyer.role").alias("role"),
        F.col("buyer.is_c_suite").alias("is_c_suite"),
        F.col("buy_shares").alias("shares"),
        F.col("buy_value").alias("value_usd"),
        F.round(F.coalesce("stake", F.lit(0.0)), 4).alias("stake_increase_pct"),
        F.col("last_buy_age").cast("long").alias("days_since_last_buy"),
    )


# -- insider files ------------------------------------------------------------------
# Transaction codes that may occur in a file.
KNOWN_CODES = ["A", "C", "D", "F", "G", "I", "J", "M", "P", "S"]


def form4_row_problems(rows: DataFrame, universe: DataFrame | None = None, start: Column | None = None,
                       end: Column | None = None) -> DataFrame:
    """Text rows of an insider file with a list of what is wrong with each."""
    t = F.upper(text("ticker"))
    number = lambda c: text(c).try_cast("double")
    cik = pad_cik("issuer_cik")
    filed, traded = lenient_date("filing_date"), lenient_date("transaction_date")
    out = rows
    outside = F.lit(False)
    if universe is not None:
        known = universe.select(F.col("ticker").alias("_u")).distinct()
        out = rows.join(known, t == F.col("_u"), "left")
        outside = (t != "") & F.col("_u").isNull()
    never = F.lit(False)
    checks = [
        (t == "", "missing_ticker"),
        (outside, "ticker_outside_universe"),
        (cik == "0000000000", "missing_issuer_cik"),
        (text("issuer_name") == "", "missing_issuer_name"),
        (text("accession") == "", "missing_accession"),
        (filed.isNull(), "invalid_filing_date"),
        (traded.isNull(), "invalid_transaction_date"),
        (traded < start if start is not None else never, "transaction_before_start"),
        (traded > end if end is not None else never, "transaction_after_end"),
        (~F.upper(text("transaction_code")).isin(*KNOWN_CODES), "unexpected_transaction_code"),
        (~F.upper(text("acquired_disposed")).isin("A", "D"), "unexpected_acquired_disposed"),
        (number("shares") <= 0, "non_positive_shares"),
        (number("shares").isNull(), "invalid_shares"),
        (number("price_per_share") < 0, "negative_price_per_share"),
        (number("price_per_share").isNull(), "invalid_price_per_share"),
    ]
    return out.withColumns({
        "t": t, "cik": cik, "traded": traded,
        "problems": F.array_compact(F.array(*[F.when(c, name) for c, name in checks])),
    }).drop("_u")


def validate_form4(rows: DataFrame, universe: DataFrame | None = None, start: Column | None = None,
                   end: Column | None = None) -> DataFrame:
    """One-row report on an insider file: bad and repeated rows, tickers outside or missing
    from the universe, tickers with several issuers, and whether the file is ready."""
    checked = form4_row_problems(rows, universe, start, end)
    # Rows with the same key are one trade. All figures follow from one fold by key, bad rows included:
    # the rows are made and checked once, and a key with many copies is folded where it is read.
    good = F.size("problems") == 0
    first = F.struct("cik", text("issuer_name").alias("name"), F.upper(text("transaction_code")).alias("code"),
                     F.upper(text("acquired_disposed")).alias("side"), "traded")
    keys = checked.groupBy(*FORM4_ROW_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("copies"),
        F.max(F.array_contains("problems", "ticker_outside_universe")).alias("outside"), F.min(F.when(good, first)).alias("r"),
    ).select(F.upper(text("ticker")).alias("t"), "rows", "copies", "outside", "r.*")
    valid = F.col("copies") > 0
    buy = (F.col("code") == "P") & (F.col("side") == "A")
    sell = (F.col("code") == "S") & (F.col("side") == "D")
    # Per ticker first: counts of tickers and of tickers with several issuers need no
    # distinct over the rows.
    per_ticker = keys.groupBy("t").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("copies")).alias("bad"), F.max("outside").alias("outside"),
        F.count_if(valid).alias("n"), F.sum(F.when(valid, F.col("copies") - 1)).alias("extra"),
        F.count_if(valid & buy).alias("buys"), F.count_if(valid & sell).alias("sells"),
        F.min("traded").alias("first"), F.max("traded").alias("last"),
        (F.min("cik") != F.max("cik")).alias("mixed"), (F.min("name") != F.max("name")).alias("renamed"),
    )
    if universe is None:
        asked = per_ticker.withColumn("asked", F.col("n") > 0)
    else:
        wanted = universe.select(F.col("ticker").alias("_u")).distinct().withColumn("asked", F.lit(True))
        asked = per_ticker.join(wanted, F.col("t") == F.col("_u"), "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = asked.agg(
        total("rows").alias("rows_total"),
        total("bad").alias("invalid_rows"),
        F.count_if("outside").alias("unexpected_tickers"),
        total("n").alias("rows_valid"),
        total("extra").alias("duplicate_rows"),
        F.count_if(F.col("n") > 0).alias("tickers_observed"),
        total("buys").alias("open_market_buy_rows"),
        F.count_if(F.col("buys") > 0).alias("open_market_buy_tickers"),
        total("sells").alias("open_market_sell_rows"),
        F.count_if(F.col("sells") > 0).alias("open_market_sell_tickers"),
        F.min("first").alias("earliest_transaction_date"),
        F.max("last").alias("latest_transaction_date"),
        F.count_if("mixed").alias("mixed_issuer_tickers"),
        F.count_if(~F.col("mixed") & F.col("renamed")).alias("issuer_name_variants"),
        F.count_if("asked").alias("ticker_universe_count"),
        F.count_if(F.col("asked") & (F.coalesce("n", F.lit(0)) == 0)).alias("tickers_empty"),
    )
    trouble = (
        (F.col("invalid_rows") + F.col("duplicate_rows") + F.col("mixed_issuer_tickers") + F.col("unexpected_tickers") > 0)
        | (F.col("rows_valid") == 0)
    )
    return out.withColumn("status", F.when(trouble, "review").otherwise("ready"))


def form4_code_counts(rows: DataFrame) -> DataFrame:
    """Valid rows per transaction code and side."""
    good = form4_row_problems(rows).filter(F.size("problems") == 0)
    distinct = good.groupBy(*FORM4_ROW_KEY).agg(
        F.min(F.upper(text("transaction_code"))).alias("code"), F.min(F.upper(text("acquired_disposed"))).alias("side"))
    return distinct.groupBy("code", "side").agg(F.count(F.lit(1)).alias("n"))


def _expected_issuer(parsed: DataFrame, expected: DataFrame) -> tuple[DataFrame, Column]:
    """Parsed trades with ``expected_issuer_cik``, and whether the issuer is that one."""
    both = parsed.join(expected.select("ticker", F.col("cik").alias("expected_issuer_cik")), "ticker")
    return both, pad_cik("issuer_cik") == F.col("expected_issuer_cik")


def guard_issuers(parsed: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed trades by whether the filing's issuer is the one expected for its
    ``ticker``: (kept trades, one row per dropped filing)."""
    both, same = _expected_issuer(parsed, expected)
    dropped = both.filter(~same).select(
        "ticker", "accession", "expected_issuer_cik", pad_cik("issuer_cik").alias("actual_issuer_cik"),
        "issuer_name", "owner_cik").distinct()
    return both.filter(same), dropped


def build_form4_rows(parsed: DataFrame, universe: DataFrame, cik_map: DataFrame, start: Column, end: Column) -> DataFrame:
    """Normalized insider rows of a ticker universe: right issuer, filed and traded inside
    the window. ``parsed`` carries the ticker it was fetched for."""
    wanted = universe.select("ticker").distinct().join(cik_map, "ticker")
    both, same = _expected_issuer(parsed, wanted)
    filed, traded = lenient_date("filing_date"), lenient_date("transaction_date")
    return both.filter(same).filter(filed.between(start, end) & traded.between(start, end)).withColumn(
        "value_usd", trade_value(F.col("shares"), F.col("price_per_share"))
    ).drop("expected_issuer_cik", "issuer_ticker")


def form4_build_summary(parsed: DataFrame, universe: DataFrame, cik_map: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: tickers asked for, without cik, without filings; filings dropped for the
    wrong issuer; rows written.

    The trades are read once: those of the right issuer fold to a row per ticker, those of
    a wrong one to a row per filing."""
    tickers = universe.select("ticker").distinct().join(cik_map, "ticker", "left").groupBy("ticker", "cik").agg(
        F.count(F.lit(1)).alias("copies"))
    same = pad_cik("issuer_cik") == F.col("cik")
    filed, traded = lenient_date("filing_date"), lenient_date("transaction_date")
    wrong = F.when(~same, F.struct("accession", pad_cik("issuer_cik").alias("actual"), "issuer_name", "owner_cik"))
    folded = parsed.join(tickers.select("ticker", "cik"), "ticker").groupBy("ticker", "cik", wrong.alias("wrong")).agg(
        F.count_if(same & filed.between(start, end) & traded.between(start, end)).alias("n"))
    seen = folded.groupBy(F.col("ticker").alias("_t"), F.col("cik").alias("_c")).agg(
        F.count("wrong").alias("wrong"), F.sum("n").alias("n"))
    both = tickers.join(seen, (F.col("ticker") == F.col("_t")) & F.col("cik").eqNullSafe(F.col("_c")), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = lambda cond: total(F.when(cond, F.col("copies")))
    return both.agg(
        total("copies").alias("tickers_requested"),
        counted(F.col("cik").isNull()).alias("tickers_without_cik"),
        counted(F.col("cik").isNotNull() & F.col("_t").isNull()).alias("tickers_without_filings"),
        total("wrong").alias("issuer_mismatch_filings"),
        total(F.col("n") * F.col("copies")).alias("rows_new"))

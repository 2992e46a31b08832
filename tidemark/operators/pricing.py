"""Price joins, portfolio valuation and checks of price files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import lenient_date, positive_double, text
from tidemark.params import HORIZONS


def close_on_or_before(points: DataFrame, prices: DataFrame, lookback: int = 7) -> DataFrame:
    """Last close at or up to ``lookback`` days before each (ticker, as_of).

    A point is matched on the handful of days it may use, so the join is a plain equi
    join on (ticker, date): a ticker with very many prices spreads over its dates.
    """
    days = F.explode(F.sequence(F.date_sub("as_of", lookback), F.col("as_of")))
    wanted = points.select("ticker", "as_of").distinct().withColumn("date", days)
    return (
        wanted.join(prices.select("ticker", "date", "adj_close"), ["ticker", "date"])
        .groupBy("ticker", "as_of")
        .agg(F.max("date").alias("price_date"), F.max_by("adj_close", "date").alias("price"))
    )


def latest_close(tickers: DataFrame, prices: DataFrame, today: Column, lookback: int = 10) -> DataFrame:
    """Last close of each ticker in the ``lookback`` days up to today."""
    recent = prices.filter(F.col("date").between(F.date_sub(today, lookback), today))
    return (
        recent.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
        .groupBy("ticker")
        .agg(F.max("date").alias("price_date"), F.max_by("adj_close", "date").alias("price"))
    )


def forward_returns(points: DataFrame, prices: DataFrame, execution_lag: int = 1,
                    horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Returns over the next 20/60/120 price rows after entering ``execution_lag`` rows
    past the first price at or after each (ticker, as_of).

    Prices are first reduced to one row per (ticker, date), so a window never holds more
    rows than there are trading days.
    """
    daily = prices.groupBy("ticker", "date").agg(F.max("adj_close").alias("px"))
    by_day = Window.partitionBy("ticker").orderBy("date")
    at = lambda c, n: F.lead(c, n).over(by_day) if n else F.col(c)
    path = F.struct(
        at("date", execution_lag).alias("entry_date"),
        at("px", execution_lag).alias("entry_price"),
        *[F.lead("px", execution_lag + h).over(by_day).alias(f"exit_{h}") for h in horizons],
    )
    priced = daily.select("ticker", F.col("date").alias("day"), F.lit(1).alias("is_price"), path.alias("path"))
    asked = points.select("ticker", F.col("as_of").alias("day")).distinct().select(
        "ticker", "day", F.lit(0).alias("is_price"), F.lit(None).cast(priced.schema["path"].dataType).alias("path")
    )
    # Walking the days backwards, the last price row seen is the first at or after the day.
    back = (
        Window.partitionBy("ticker").orderBy(F.col("day").desc(), F.col("is_price").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        priced.unionByName(asked)
        .withColumn("path", F.last("path", ignorenulls=True).over(back))
        .filter("is_price = 0 and path.entry_date is not null")
    )
    exits = [F.col(f"path.exit_{h}") for h in horizons]
    return found.select(
        "ticker",
        F.col("day").alias("as_of"),
        F.col("path.entry_date").alias("execution_timestamp"),
        F.round("path.entry_price", 6).alias("adjusted_entry_price"),
        F.round(F.coalesce(*reversed(exits)), 6).alias("adjusted_exit_price"),
        *[
            F.round(e / F.col("path.entry_price") - 1.0, 8).alias(f"forward_return_{h}d")
            for h, e in zip(horizons, exits)
        ],
    )


def value_portfolios(snapshots: DataFrame, prices: DataFrame, today: Column,
                     fundamentals: DataFrame | None = None, lookback: int = 7,
                     latest_lookback: int = 10) -> DataFrame:
    """Every position at today's price: status, current value and weight, paper profit,
    and how well reported value agrees with shares x price. Options and positions
    without a ticker or price are carried at the reported value."""
    long = snapshots.filter("put_call = '' and coalesce(ticker, '') <> ''")
    basis = close_on_or_before(long.select("ticker", F.col("report_date").alias("as_of")), prices, lookback)
    basis = basis.toDF("ticker", "report_date", "basis_date", "px_basis")
    now = latest_close(long, prices, today, latest_lookback).select("ticker", F.col("price").alias("px_now"))
    out = snapshots.join(basis, ["ticker", "report_date"], "left").join(now, "ticker", "left")
    status = (
        F.when(F.col("put_call") != "", "option")
        .when(F.coalesce("ticker", F.lit("")) == "", "no_ticker")
        .when(F.col("px_now").isNull() | F.col("px_basis").isNull(), "no_price")
        .otherwise("priced")
    )
    out = out.withColumn("status", status)
    priced = F.col("status") == "priced"
    current = F.when(priced, F.col("shares") * F.col("px_now")).otherwise(F.col("value_usd"))
    basis_value = F.when(priced, F.col("shares") * F.col("px_basis"))
    out = out.withColumns({"current_value": current, "basis_value": basis_value}).withColumns(
        {
            "pnl_abs": F.col("current_value") - F.col("basis_value"),
            "pnl_pct": F.when(priced, F.try_divide("px_now", F.nullif("px_basis", F.lit(0.0))) - 1.0),
            "reconcile_ratio": F.try_divide("value_usd", F.nullif("basis_value", F.lit(0.0))),
        }
    )
    if fundamentals is not None:
        f = fundamentals.select("ticker", "market_cap", "shares_outstanding")
        out = out.join(f, "ticker", "left").withColumns(
            {
                "market_cap": F.when(priced, F.col("market_cap")),
                "pct_of_company": F.when(
                    priced, F.try_divide("shares", F.nullif("shares_outstanding", F.lit(0.0)))
                ),
            }
        ).drop("shares_outstanding")
    totals = out.groupBy("accession").agg(F.sum("current_value").alias("_total"))
    return (
        out.join(totals, "accession")
        .withColumn("current_weight", F.when(F.col("_total") > 0, F.col("current_value") / F.col("_total")).otherwise(0.0))
        .drop("_total")
    )


def valuation_totals(valued: DataFrame, *keys: str) -> DataFrame:
    """Totals of a valued portfolio and of its priced sleeve."""
    priced = F.col("status") == "priced"
    return (
        valued.groupBy(*keys)
        .agg(
            F.sum("value_usd").alias("reported_total"),
            F.sum("current_value").alias("current_total"),
            F.coalesce(F.sum("basis_value"), F.lit(0.0)).alias("priced_basis_total"),
            F.coalesce(F.sum(F.when(priced, F.col("current_value"))), F.lit(0.0)).alias("priced_current_total"),
        )
        .withColumn("pnl_abs", F.col("priced_current_total") - F.col("priced_basis_total"))
        .withColumn("pnl_pct", F.try_divide("pnl_abs", F.nullif("priced_basis_total", F.lit(0.0))))
        .withColumn("unpriced_value", F.col("current_total") - F.col("priced_current_total"))
    )


# -- price files -------------------------------------------------------------
def price_row_problems(rows: DataFrame) -> DataFrame:
    """Parse raw (ticker, date, adj_close) text rows and list what is wrong with each."""
    parsed = rows.withColumns(
        {"t": F.upper(text("ticker")), "d": lenient_date("date"), "px": positive_double("adj_close")}
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("t") == "", "missing_ticker"),
            F.when(F.col("d").isNull(), "invalid_date"),
            F.when(F.col("px").isNull(), "invalid_adj_close"),
        )
    )
    return parsed.withColumn("problems", problems)


def price_days(rows: DataFrame) -> DataFrame:
    """Valid (ticker, date) pairs with how often they occur."""
    good = price_row_problems(rows).filter(F.size("problems") == 0)
    return good.groupBy(F.col("t").alias("ticker"), F.col("d").alias("date")).agg(
        F.count(F.lit(1)).alias("copies")
    )


def price_history(days: DataFrame, universe: DataFrame, start: Column, end: Column) -> DataFrame:
    """First and last date, row count, largest gap and completeness per ticker of the
    universe. ``days`` holds one row per (ticker, date)."""
    by_day = Window.partitionBy("ticker").orderBy("date")
    stepped = days.withColumn("prev", F.lag("date").over(by_day)).withColumn(
        "gap", F.datediff("date", "prev")
    )
    # Largest gap; of equal gaps the earliest.
    widest = F.max(F.when(F.col("gap").isNotNull(), F.struct(
        F.col("gap"), (-F.datediff("prev", F.lit("1970-01-01").cast("date"))).alias("_early"), F.col("prev"), F.col("date"))))
    per = stepped.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        widest.alias("w"),
    )
    out = universe.select("ticker").distinct().join(per, "ticker", "left")
    missing_start = F.coalesce(F.col("first_date") > start, F.lit(False))
    missing_end = F.coalesce(F.col("last_date") < end, F.lit(False))
    return out.select(
        "ticker",
        F.coalesce("n_days", F.lit(0)).alias("n_days"),
        "first_date", "last_date",
        missing_start.alias("missing_start"), missing_end.alias("missing_end"),
        F.col("w.gap").alias("max_gap_days"),
        F.col("w.prev").alias("gap_from"), F.col("w.date").alias("gap_to"),
        F.when(F.col("n_days").isNull(), "empty")
        .when(missing_start | missing_end, "partial")
        .otherwise("complete").alias("history"),
    )


def validate_prices(rows: DataFrame, universe: DataFrame | None, start: Column, end: Column,
                    max_gap_days: int = 10) -> DataFrame:
    """One-row report on a raw price table: invalid and duplicate rows, empty and partial
    tickers, large gaps, and whether it is ready for use."""
    checked = price_row_problems(rows)
    row_counts = checked.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.size("problems") > 0).alias("invalid_rows"),
    )
    days = price_days(rows)
    wanted = days.select("ticker") if universe is None else universe
    per_ticker = price_history(days, wanted, start, end).agg(
        F.count(F.lit(1)).alias("ticker_universe_count"),
        F.count_if(F.col("history") == "empty").alias("tickers_empty"),
        F.count_if(F.col("history") == "partial").alias("tickers_partial_history"),
        F.count_if(F.col("max_gap_days") > max_gap_days).alias("major_gaps"),
        F.min("first_date").alias("earliest_price_date"),
        F.max("last_date").alias("latest_price_date"),
    )
    day_counts = days.agg(
        F.count(F.lit(1)).alias("rows_valid"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_distinct("ticker").alias("tickers_observed"),
    )
    one = F.lit(1).alias("_k")
    out = (
        row_counts.select("*", one)
        .join(day_counts.select("*", one), "_k")
        .join(per_ticker.select("*", one), "_k")
        .drop("_k")
    )
    trouble = sum(
        (F.col(c) for c in ("invalid_rows", "duplicate_rows", "tickers_empty",
                            "tickers_partial_history", "major_gaps")), F.lit(0))
    return out.withColumn("status", F.when(trouble > 0, "review").otherwise("ready"))


def merge_prices(existing: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """Old and new price rows with one row per (ticker, date), the new one winning.
    Unless forced, tickers already present keep their rows and new ones are skipped."""
    if not force:
        fresh = fresh.join(existing.select("ticker").distinct(), "ticker", "left_anti")
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return tagged.groupBy("ticker", "date").agg(F.max_by("adj_close", "_new").alias("adj_close"))

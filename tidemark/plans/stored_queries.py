"""Registered queries on stored quarters, a price source, and tables whose old rows end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import holdings, moves, pricing
from tidemark.plans.driver_tables import NOW, Tables
from tidemark.plans.filing_queries import ratio
from tidemark.plans.workspace_queries import _event_stream
from tidemark.session import shared_folder
from tidemark.sources.holdings_store import HoldingsStore
from tidemark.sources.price_source import PUSHDOWN, PriceSource
from tidemark.streaming import jobs, retention


def _store(t: Tables) -> HoldingsStore:
    store = HoldingsStore(t.spark, shared_folder(t.spark, "store"))
    store.save(t.positions())
    return store


def p5_stored_range(spark, sf):
    """Resolved filings of eight stored quarters; only their folders are read."""
    day = lambda d: F.lit(d).cast("date")
    filings = _store(Tables(spark, sf)).filings(day("2023-03-31"), day("2024-12-31"))
    return holdings.resolve_filings(filings).select("cik", "report_date", "accession")


def j3_stored_diff(spark, sf):
    """Moves between every fund's two newest quarters, from the folders of these quarters."""
    store = _store(Tables(spark, sf))
    two = store.newest(2)
    link = two.select("report_date", "accession", "recency", "prev_report_date", "next_report_date", "next_accession", "next_filing_date")
    newest = two.filter("recency = 1 and prev_report_date is not null").select("cik", "report_date")
    return moves.quarter_moves(store.of(link)).join(newest, ["cik", "report_date"], "left_semi").select(
        "cik", "report_date", "cusip", "put_call", "move", "prev_shares", "curr_shares")


def j16_stored_holders(spark, sf):
    """Holders of each security in the newest quarter that is stored."""
    store = _store(Tables(spark, sf))
    chain = holdings.resolve_filings(store.filings())
    newest = chain.agg(F.max("report_date").alias("d"))
    chosen = chain.filter(F.col("report_date") == newest.scalar()).select("report_date", "accession")
    return store.of(chosen).filter("put_call = ''").groupBy("report_date", "cusip").agg(
        F.count(F.lit(1)).alias("holders"), F.round(F.sum("value_usd"), 2).alias("value_usd"))


def u1_price_source(spark, sf):
    """Close on or before every month end of two years, from a data source of prices in ranges of tickers."""
    own = spark.newSession()  # the setting and the name of the source hold for this query only
    own.conf.set(*PUSHDOWN)
    own.dataSource.register(PriceSource)
    t = Tables(own, sf)
    path = shared_folder(own, "prices")
    t.prices().write.parquet(path)
    stored = own.read.format("tidemark_prices").option("path", path).option("splits", "TB,TC").load()
    prices = stored.filter(F.col("date").between(F.lit("2022-01-01").cast("date"), F.lit("2023-12-31").cast("date")))
    points = prices.select("ticker", F.last_day("date").alias("as_of")).distinct()
    return pricing.close_on_or_before(points, prices, 7).select("ticker", "as_of", "price_date", ratio("price"))


def st6_pruned_audit(spark, sf):
    """Audit rows stored by day and pruned to ten days: whole days by their folders, the edge day by its rows."""
    path = shared_folder(spark, "audit")
    retention.write_by_day(Tables(spark, sf).audit(), path)
    cutoff = dt.datetime.fromisoformat(NOW) - dt.timedelta(days=10)
    return retention.prune_days(spark, path, cutoff).select("before", "after", "deleted", "days_dropped")


def st7_family_counters(spark, sf):
    """Daily counters by tool and client family, kept in state for 14 days of the stream's time."""
    own = spark.newSession()
    own.conf.set(*jobs.ROCKSDB)
    log = jobs.updates_table(retention.day_counters(_event_stream(Tables(own, sf)).telemetry(), days=14, late="1 hour"), "day-counters")
    first = log.agg(F.date_sub(F.max("day"), 13).alias("d"))
    return retention.live_counters(log).filter(F.col("day") >= first.scalar())


QUERIES = {f.__name__: f for f in (p5_stored_range, j3_stored_diff, j16_stored_holders, u1_price_source, st6_pruned_audit, st7_family_counters)}

"""Pages: sections of unequal shape as one long table.

Every entry of every section is a row (keys, section, place, available) with one typed struct of fields, of
which a section fills those it has. Entries are ranked within their section; with a limit only the
first are kept, and ``available`` says how many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import audit as au
from tidemark.operators import moves as mv
from tidemark.operators.holdings import current_filing

FIELDS = {"name": "string", "code": "string", "day": "date", "at": "timestamp", "amount": "double", "ratio": "double", "n": "bigint", "detail": "string"}


def section(rows: DataFrame, keys: list[str], title: str, order: list[Column | str], most: int | None = None, /, **fields: Column | str) -> DataFrame:
    """The entries of one section of the pages that ``keys`` name."""
    value = {f: F.col(x) if isinstance(x, str) else x for f, x in fields.items()}
    filled = F.struct(*(value.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()))
    count = F.count(F.lit(1)).alias("available")
    if keys:
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        ranked = ranked if most is None else ranked.filter(F.col("place") <= most)
        joined = ranked.join(rows.groupBy(*keys).agg(count), keys)
    else:  # one page: its few first entries are ranked, not all
        first = rows.orderBy(*order) if most is None else rows.orderBy(*order).limit(most)
        joined = first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("available", rows.agg(count).scalar())
    return joined.select(*keys, F.lit(title).alias("section"), "place", "available", filled.alias("entry"))


def page(*sections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def result_windows(pages: DataFrame, *keys: str) -> DataFrame:
    """Per page and section how many entries are returned, and how many there are."""
    return pages.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("returned"), F.max("available").alias("available"))


def ticker_pages(moves: DataFrame, gate: DataFrame, flow: DataFrame, holders: int | None = 10, movements: int | None = 10) -> DataFrame:
    """Per (quarter, ticker): score, confidence, holders and movements of trusted funds, and the funds left out.

    ``moves`` are of all funds, ``gate`` says which of them are trusted and why others aren't, ``flow`` is
    the flow of the trusted ones. Confidence is ok where no fund on the ticker was left out."""
    keys = ["report_date", "ticker"]
    long = moves.filter("put_call = '' and coalesce(ticker, '') <> ''").join(
        gate.select("cik", "label", "status", "status_rank", "signal_eligible", "reasons"), "cik")
    long = long.join(flow.select("report_date").distinct(), "report_date", "left_semi")
    trusted = long.filter("signal_eligible")
    held = trusted.filter("move <> 'EXIT'").groupBy(*keys, "cik").agg(
        F.max("label").alias("label"), F.round(F.sum("curr_value"), 2).alias("value"), F.round(F.sum("curr_weight"), 6).alias("weight"))
    moved = trusted.filter("move <> 'HOLD'").withColumn("size", F.round(F.greatest("curr_value", "prev_value"), 2))
    left_out = long.filter("not signal_eligible").groupBy(*keys, "cik").agg(
        F.max("label").alias("label"), F.max("status").alias("status"), F.max("status_rank").alias("rank"), F.max(F.array_join("reasons", ";")).alias("reasons"))
    funds = long.groupBy(*keys, "cik").agg(F.max("signal_eligible").alias("ok")).groupBy(*keys).agg(
        F.count_if("ok").alias("trusted"), F.count_if(~F.col("ok")).alias("excluded"))
    said = F.concat(F.col("trusted").cast("string"), F.lit(" trusted, "), F.col("excluded").cast("string"), F.lit(" excluded"))
    return page(
        section(flow, keys, "score", ["score"], amount="score", code="action", detail=F.array_join("triggers", ";")),
        section(funds, keys, "confidence", ["trusted"], code=F.when(F.col("excluded") == 0, "ok").otherwise("partial"),
                ratio=F.round(F.col("trusted") / (F.col("trusted") + F.col("excluded")), 6), n="trusted", detail=said),
        section(held, keys, "holders", [F.col("value").desc(), "cik"], holders, name="label", code="cik", amount="value", ratio="weight"),
        section(moved, keys, "movements", [F.col("size").desc(), "cik", "cusip"], movements, name="label", code="move", amount="size", detail=mv.move_detail()),
        section(left_out, keys, "excluded", [F.col("rank").desc(), "cik"], None, name="label", code="status", detail="reasons"),
    )


def fund_pages(chain: DataFrame, positions: DataFrame, moves: DataFrame, gate: DataFrame, found: DataFrame,
               most_positions: int | None = 25, most_moves: int | None = 25, quarters: int | None = 8, holds: bool = False) -> DataFrame:
    """Per fund: its newest filing and the one before, positions, moves and their counts, the findings that
    concern it, and its last quarters. ``positions`` and ``moves`` are those of the newest quarters."""
    key = ["cik"]
    newest = current_filing(chain.select("cik", "report_date", "accession", "form", "filing_date", "total_value", "prev_report_date", "prev_accession"))
    held = positions.withColumns({"v": F.round("value_usd", 2), "w": F.round("weight", 6)})
    changes = (moves if holds else moves.filter("move <> 'HOLD'")).withColumn("size", F.round(F.greatest("curr_value", "prev_value"), 2))
    counts = moves.groupBy("cik", "move").agg(F.count(F.lit(1)).alias("n"))
    return page(
        section(newest, key, "filing", ["accession"], name="accession", code="form", day="filing_date", amount=F.round("total_value", 2)),
        section(newest.filter("prev_accession is not null"), key, "previous_filing", ["accession"], name="prev_accession", day="prev_report_date"),
        section(held, key, "positions", [F.col("v").desc(), "cusip", "put_call"], most_positions, name="issuer", code="cusip", amount="v", ratio="w", detail="put_call"),
        section(changes, key, "moves", [F.col("size").desc(), "cusip", "put_call"], most_moves, name="issuer", code="move", amount="size", detail=mv.move_detail()),
        section(counts, key, "counts", ["move"], code="move", n="n"),
        section(gate, key, "quality", ["status"], code="status", n="series_points", detail=F.array_join("reasons", ";")),
        section(found, key, "findings", ["kind", F.col("event_quarter").asc_nulls_first(), "detail"], None, name="kind", code="temporal_scope", day="event_quarter"),
        section(chain, key, "quarters", [F.col("report_date").desc()], quarters, day="report_date", amount=F.round("total_value", 2), n="n_positions"),
    )


def health_sections(audit: DataFrame, keys: DataFrame, watchlists: DataFrame, snapshots: DataFrame, alerts: DataFrame, now: Column,
                    top_keys: int = 25, routes: int = 15, errors: int = 10, recent_keys: int = 10) -> DataFrame:
    """What a health report lists: use by key, recent routes and errors, newest keys, and workspace totals."""
    use = au.usage_report(audit, keys, now)
    per_route = audit.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest"))
    total = lambda df, name, at=None: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), (F.max(at) if at else F.lit(None).cast("timestamp")).alias("latest"))
    workspace = page(total(watchlists, "watchlists"), total(snapshots, "signal_snapshots", "created_at"), total(alerts, "alerts", "last_seen_at"),
                     total(alerts.filter("status = 'open'"), "open_alerts"))
    return page(
        section(use, [], "usage", [F.col("day_used").desc(), F.col("minute_used").desc(), F.col("created_at").desc(), "key_id"], top_keys,
                name="key_id", code="tier", n="day_used", amount=F.col("minute_used").cast("double")),
        section(per_route, [], "routes", [F.col("latest").desc(), "route"], routes, name="route", n="n", at="latest"),
        section(audit.filter("status >= 400"), [], "recent_errors", [F.col("at").desc(), F.col("id").desc()], errors, name="route", code="method", n="status", at="at", detail="key_id"),
        section(keys, [], "recent_keys", [F.col("created_at").desc(), "key_id"], recent_keys, name="key_id", code="tier", at="created_at"),
        section(workspace, [], "workspace", ["name"], name="name", n="n", at="latest"),
    )


#: What a closeout verdict rests on.
VERDICT_REASONS = {
    "no_keys": "no key was used in the window", "server_errors": "server errors in the window", "no_success": "no request succeeded",
    "lifecycle": "a key has to be renewed before more use", "adopted": "repeated use with saved work", "thin": "used, but too little to go on",
}


def verdict_reason() -> Column:
    """Why closeout_verdict() came to its verdict, from the same totals."""
    r = {k: F.lit(v) for k, v in VERDICT_REASONS.items()}
    return (
        F.when(F.col("keys") == 0, r["no_keys"]).when(F.col("server_errors") > 0, r["server_errors"]).when(F.col("ok") == 0, r["no_success"])
        .when(F.col("lifecycle_actions") > 0, r["lifecycle"])
        .when((F.col("requests") >= 10) & ((F.col("watchlists") > 0) | (F.col("snapshots") > 0)), r["adopted"]).otherwise(r["thin"])
    )


def closeout_sections(audit: DataFrame, chosen: DataFrame, alerts: DataFrame, now: Column, days: int = 7, routes: int = 10, top_alerts: int = 5) -> DataFrame:
    """Per closed-out key: the routes it used most in the window, and its top alerts."""
    since = now - F.expr(f"INTERVAL {int(days)} DAYS")
    key = ["key_id"]
    used = audit.filter(F.col("at") >= since).join(chosen.select("key_id"), "key_id", "left_semi").groupBy("key_id", "route", "method").agg(
        F.count(F.lit(1)).alias("n"), F.max("at").alias("latest"), F.count_if(F.col("status") >= 400).alias("errors"))
    own = alerts.join(chosen.select("key_id"), "key_id", "left_semi")
    return page(
        section(used, key, "routes", [F.col("n").desc(), F.col("latest").desc(), "route", "method"], routes, name="route", code="method", n="n", amount=F.col("errors").cast("double"), at="latest"),
        section(own, key, "top_alerts", [F.col("severity").desc(), F.col("last_seen_at").desc(), "ticker", "alert_id"], top_alerts,
                name="ticker", code="action", n="severity", detail="status", at="last_seen_at"),
    )


def sample_accessions(resolved: DataFrame, most: int = 5) -> DataFrame:
    """Filings of the newest quarter, those filed last first, with how many there are."""
    newest = resolved.agg(F.max("report_date").alias("d"))
    latest = resolved.filter(F.col("report_date") == newest.scalar())
    return section(latest, [], "accessions", [F.col("filing_date").desc(), "accession"], most, name="accession", code="cik", day="filing_date", n="n_positions")

"""Ticker flow over trusted funds, watchlists, their snapshots and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.texts import alert_severity
from tidemark.functions.values import clamp, saturating
from tidemark.operators import moves as mv

# Order of actions in a ranked list.
ACTION_RANK = {"alert": 0, "watch": 1, "monitor": 2, "blocked": 3}


def flow_score() -> Column:
    """Ordinal 0..100 score of a quarter's fund moves on a ticker."""
    buyers, sellers = F.col("buyers_count"), F.col("sellers_count")
    return clamp(
        30.0 * saturating(buyers, 2.0)
        + 30.0 * saturating(F.col("new_positions"), 1.0)
        + 20.0 * F.least(F.lit(1.0), F.coalesce(F.col("avg_weight"), F.lit(0.0)) / 0.05)
        + 20.0 * saturating(F.greatest(buyers - sellers, F.lit(0)), 2.0)
        - 20.0 * saturating(sellers, 2.0),
        0.0, 100.0,
    )


def ticker_flow(moves: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """Movement summary, score, action and triggers per (quarter, ticker) over trusted funds."""
    long = moves.filter("put_call = '' and coalesce(ticker, '') <> ''")
    if trusted is not None:
        long = long.join(trusted.select("cik").distinct(), "cik", "left_semi")
    return add_actions(mv.ticker_summary(long, "report_date", "ticker", weights=True))


def add_actions(flow: DataFrame) -> DataFrame:
    out = flow.withColumn("score", F.round(flow_score(), 6))
    score, fresh = F.col("score"), F.col("new_positions") >= 1
    silent = (F.col("holder_count") + F.col("buyers_count") + F.col("sellers_count")) == 0
    action = (
        F.when(silent, "blocked").when((score >= 50) | (fresh & (score >= 30)), "alert")
        .when(score >= 30, "watch").otherwise("monitor")
    )
    triggers = F.array_compact(F.array(
        F.when(F.col("buyers_count") >= 2, "accumulation"),
        F.when(score >= 50, "high_score"),
        F.when(fresh, "new_position"),
    ))
    return out.withColumns({"action": action, "triggers": triggers})


def watchlist_preview(flow: DataFrame, tickers: DataFrame) -> DataFrame:
    """The given tickers with their flow; a ticker nobody moved is blocked."""
    empty = {c: F.coalesce(F.col(c), F.lit(0)) for c in (
        "holder_count", "buyers_count", "sellers_count", "new_positions", "exits")}
    joined = tickers.select("ticker").distinct().join(flow, "ticker", "left").withColumns(empty)
    return joined.withColumns({
        "action": F.coalesce("action", F.lit("blocked")),
        "score": F.coalesce("score", F.lit(0.0)),
        "triggers": F.coalesce("triggers", F.array().cast("array<string>")),
        "movement_codes": F.coalesce("movement_codes", F.array().cast("array<string>")),
        "total_value_usd": F.coalesce("total_value_usd", F.lit(0.0)),
    })


def with_links(preview: DataFrame, base: str = "") -> DataFrame:
    """Preview rows with ``links``: where a ticker's page and its data are, below ``base``."""
    at = lambda path: F.concat(F.lit(f"{base}/{path}/"), F.url_encode("ticker"))
    return preview.withColumn("links", F.struct(at("stocks").alias("page"), at("api/stocks").alias("data")))


def matches(actions=None, moves=None, min_score=None, min_holders=None, min_buyers=None, max_value=None) -> Column:
    """Saved-filter predicate. Every argument may be a constant or a column; a null or empty
    one switches its clause off."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    listed = lambda v: v if isinstance(v, Column) else (F.array(*[F.lit(x) for x in v]) if v else F.lit(None).cast("array<string>"))
    off = lambda v: v.isNull() | (F.size(F.coalesce(v, F.array().cast("array<string>"))) == 0)
    a, m = listed(actions), listed(moves)
    at_least = lambda c, v: lit(v).isNull() | (F.coalesce(F.col(c), F.lit(0)) >= lit(v))
    return (
        (off(a) | F.array_contains(a, F.col("action")))
        & (off(m) | F.arrays_overlap(m, F.col("movement_codes")))
        & at_least("score", min_score) & at_least("holder_count", min_holders) & at_least("buyers_count", min_buyers)
        & (lit(max_value).isNull() | (F.coalesce(F.col("total_value_usd"), F.lit(0.0)) <= lit(max_value)))
    )


def action_rank() -> Column:
    out = F.lit(len(ACTION_RANK))
    for name, rank in ACTION_RANK.items():
        out = F.when(F.col("action") == name, rank).otherwise(out)
    return out


def discover(flow: DataFrame, limit: int = 25, mega_cap_usd: float | None = None, **filters) -> DataFrame:
    """Best candidates over all tickers: filtered, ranked by action, score, buyers, openings."""
    kept = flow.filter(matches(**filters))
    if mega_cap_usd is not None:
        kept = kept.filter(F.col("total_value_usd") < mega_cap_usd)
    return kept.orderBy(
        action_rank(), F.col("score").desc(), F.col("buyers_count").desc(), F.col("new_positions").desc(), "ticker"
    ).limit(int(limit))


def watchlist_signals(watchlists: DataFrame, flow: DataFrame) -> DataFrame:
    """Saved watchlists against one quarter's flow, each with its own filters."""
    wanted = watchlists.select("*", F.explode("tickers").alias("ticker")).drop("tickers")
    wanted = wanted.withColumnsRenamed({"actions": "f_actions", "moves": "f_moves"})
    return wanted.join(flow, "ticker").filter(matches(
        F.col("f_actions"), F.col("f_moves"), F.col("min_score"), F.col("min_holders"), F.col("min_buyers"),
        F.col("max_13f_value_usd")))


def action_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[
        F.count_if(F.col("action") == a).alias(n) for a, n in (
            ("alert", "alerts"), ("watch", "watch"), ("monitor", "monitor"), ("blocked", "blocked"))])


def snapshot_delta(current: DataFrame, previous: DataFrame, *keys: str) -> DataFrame:
    """Per (keys, ticker): added, removed, changed action, or score moved by 0.1 or more."""
    side = lambda df, p: df.select(*keys, F.upper(F.trim("ticker")).alias("ticker"), F.col("action").alias(f"{p}_action"), F.col("score").alias(f"{p}_score"))
    both = side(current, "to").join(side(previous, "from"), [*keys, "ticker"], "full_outer")
    return both.withColumns({
        "change": F.when(F.col("from_action").isNull(), "added").when(F.col("to_action").isNull(), "removed").otherwise("kept"),
        "action_changed": F.coalesce(F.col("from_action") != F.col("to_action"), F.lit(False)),
        "score_changed": F.coalesce(F.abs(F.col("to_score") - F.col("from_score")) >= 0.1, F.lit(False)),
    })


# -- schedule --------------------------------------------------------------------
def watchlist_schedule(watchlists: DataFrame, keys: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """Watchlists of usable keys with their newest snapshot and whether they are due."""
    usable = keys.filter(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    newest = snapshots.groupBy("key_id", "watchlist_id").agg(F.max("created_at").alias("latest_snapshot_at"))
    out = watchlists.join(usable.select("key_id", F.col("label").alias("key_label")), "key_id").join(
        newest, ["key_id", "watchlist_id"], "left")
    cadence = F.when(F.col("frequency") == "weekly", F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 1 DAYS"))
    valid = F.col("enabled") & F.col("frequency").isin("daily", "weekly")
    due = valid & (F.col("latest_snapshot_at").isNull() | (F.col("latest_snapshot_at") <= now - cadence))
    return out.withColumns({"valid": valid, "due": due})


def due_watchlists(schedule: DataFrame, limit: int | None = None) -> DataFrame:
    """Due watchlists, never-run ones first, then the longest waiting."""
    out = schedule.filter("due").orderBy(
        F.col("latest_snapshot_at").asc_nulls_first(), F.col("updated_at").desc(), "watchlist_id")
    return out if limit is None else out.limit(limit)


def schedule_summary(schedule: DataFrame) -> DataFrame:
    on = F.col("enabled")
    return schedule.agg(
        F.count_if(on).alias("scheduled_watchlists"),
        F.count_if(on & (F.col("frequency") == "daily")).alias("daily"),
        F.count_if(on & (F.col("frequency") == "weekly")).alias("weekly"),
        F.count_if(on & ~F.col("frequency").isin("daily", "weekly")).alias("invalid_policy"),
        F.count_if("due").alias("due_count"),
        F.max(F.when(F.col("valid"), F.col("latest_snapshot_at"))).alias("latest_snapshot_at"),
    )


# -- alerts ---------------------------------------------------------------------------
ALERT_KEY = ["key_id", "watchlist_id", "ticker", "action"]


def alert_candidates(signals: DataFrame, snapshot_id: Column, now: Column) -> DataFrame:
    """Alert rows of a snapshot: alert and watch actions only."""
    return signals.withColumn("severity", alert_severity(F.col("action"))).filter(
        "severity is not null and trim(ticker) <> ''"
    ).select(*ALERT_KEY, "severity", F.col("score").alias("reason_score"), snapshot_id.alias("snapshot_id"), now.alias("seen_at"))


def upsert_alerts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """New alerts open; known ones keep first_seen and status and take the rest from the
    newest candidate."""
    pick = F.max(F.struct("seen_at", "severity", "reason_score", "snapshot_id")).alias("n")
    new = batch.groupBy(*ALERT_KEY).agg(pick, F.min("seen_at").alias("_first"))
    return stored.join(new, ALERT_KEY, "full_outer").select(
        *ALERT_KEY,
        F.coalesce("n.severity", "severity").alias("severity"),
        F.coalesce("n.reason_score", "reason_score").alias("reason_score"),
        F.coalesce("n.snapshot_id", "snapshot_id").alias("snapshot_id"),
        F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("first_seen_at", "_first").alias("first_seen_at"),
        F.coalesce("n.seen_at", "last_seen_at").alias("last_seen_at"),
    )


def fold_alert_status(events: DataFrame) -> DataFrame:
    """Status of every alert after its status events. Reopening clears both stamps, so only
    events after the last reopening count. One aggregation finds it, the next folds."""
    opened = events.groupBy("alert_id").agg(F.max(F.when(F.col("status") == "open", F.col("at"))).alias("_open"))
    live = events.join(opened, "alert_id").filter(F.col("_open").isNull() | (F.col("at") >= F.col("_open")))
    return live.groupBy("alert_id").agg(
        F.max_by("status", F.struct("at", "status")).alias("status"),
        F.max(F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("status") == "dismissed", F.col("at"))).alias("dismissed_at"),
    )


def list_alerts(alerts: DataFrame, status: str | None = "open", limit: int | None = None, *keys: str) -> DataFrame:
    """Alerts by severity, then newest, then ticker; with a ``limit``, at most so many per key."""
    kept = alerts if status is None else alerts.filter(F.col("status") == status)
    order = Window.partitionBy(*(keys or ("key_id",))).orderBy(
        F.col("severity").desc(), F.col("last_seen_at").desc(), "ticker", "alert_id")
    ranked = kept.withColumn("alert_rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("alert_rank") <= limit)


def newest_and_previous(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of each watchlist with the one before it."""
    order = Window.partitionBy("key_id", "watchlist_id").orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
    two = snapshots.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 2")
    at = lambda n, c: F.max(F.when(F.col("_rn") == n, F.col(c)))
    return two.groupBy("key_id", "watchlist_id").agg(
        at(1, "snapshot_id").alias("snapshot_id"), at(1, "created_at").alias("created_at"),
        at(2, "snapshot_id").alias("baseline_snapshot_id"))


# -- deliveries --------------------------------------------------------------------------
def pending_deliveries(subscriptions: DataFrame, deliveries: DataFrame, newest: DataFrame) -> DataFrame:
    """Active subscriptions whose fund's newest filing was not sent or primed yet; failed
    ones come again."""
    done = deliveries.filter(F.col("status").isin("sent", "primed")).select("subscription_id", "accession").distinct()
    return (
        subscriptions.filter("active").join(newest.select("cik", "accession"), "cik")
        .join(done, ["subscription_id", "accession"], "left_anti")
    )


def prime_subscriptions(subscriptions: DataFrame, newest: DataFrame) -> DataFrame:
    """Delivery rows that mark a new subscriber's current filing as known."""
    return subscriptions.join(newest.select("cik", "accession"), "cik").select(
        "subscription_id", "accession", F.lit("primed").alias("status"))


def latest_deliveries(log: DataFrame) -> DataFrame:
    """Outcome per (subscription, filing) from an append-only log: the newest entry, and a
    terminal one is never undone."""
    rank = F.when(F.col("status").isin("sent", "primed"), 1).otherwise(0)
    return log.groupBy("subscription_id", "accession").agg(
        F.max_by("status", F.struct(rank, "delivered_at", "status")).alias("status"), F.max("delivered_at").alias("delivered_at"))


def upsert_subscriptions(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """A repeated request reactivates the stored subscription and keeps its id."""
    key = ["user_id", "cik", "channel", "target"]
    asked = requests.groupBy(*key).agg(F.min("subscription_id").alias("_new"))
    return stored.join(asked, key, "full_outer").select(
        F.coalesce("subscription_id", "_new").alias("subscription_id"), *key,
        F.when(F.col("_new").isNotNull(), True).otherwise(F.col("active")).alias("active"))

"""Usage, audit and telemetry reports over event logs.

All roll-ups are hash aggregations with map-side combine; a key that holds much of the
log is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.values import quota_remaining, quota_used_pct, safe_duration


def status_rollup(audit: DataFrame, *keys: str) -> DataFrame:
    """Requests by status class, with the newest time."""
    s = F.col("status")
    aggs = [
        F.count(F.lit(1)).alias("total"), F.max("at").alias("latest_at"),
        F.count_if(s.between(200, 399)).alias("ok"), F.count_if(s == 401).alias("unauthorized"),
        F.count_if(s == 403).alias("forbidden"), F.count_if(s == 429).alias("rate_limited"),
        F.count_if(s >= 500).alias("server_errors"),
    ]
    return audit.groupBy(*keys).agg(*aggs) if keys else audit.agg(*aggs)


def route_rollup(audit: DataFrame, top: int, *keys: str) -> DataFrame:
    """Most used routes per key: count, newest time and errors."""
    per_route = audit.groupBy(*keys, "route", "method").agg(
        F.count(F.lit(1)).alias("count"), F.max("at").alias("latest_at"),
        F.count_if(F.col("status") >= 400).alias("errors"))
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("latest_at").desc(), "route", "method")
    return per_route.withColumn("route_rank", F.row_number().over(order)).filter(F.col("route_rank") <= top)


def usage_buckets(events: DataFrame) -> DataFrame:
    """Requests per key and UTC minute; days and months are sums of minutes."""
    return events.groupBy("key_id", F.date_trunc("minute", "at").alias("minute")).agg(F.count(F.lit(1)).alias("count"))


def usage_report(events: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Use in the current minute, day and month against the limits of every key."""
    u = usage_buckets(events.filter((F.col("at") <= now) & (F.col("at") >= F.date_trunc("month", now))))
    within = lambda unit: F.sum(F.when(F.col("minute") >= F.date_trunc(unit, now), F.col("count")).otherwise(0))
    used = u.groupBy("key_id").agg(
        within("minute").alias("minute_used"), within("day").alias("day_used"), F.sum("count").alias("month_used"))
    out = keys.join(used, "key_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("minute_used", "day_used", "month_used")})
    return out.withColumns({
        "minute_remaining": quota_remaining(F.col("minute_used"), F.col("rate_per_min")),
        "minute_used_pct": quota_used_pct(F.col("minute_used"), F.col("rate_per_min")),
        "day_remaining": quota_remaining(F.col("day_used"), F.col("rate_per_day")),
        "day_used_pct": quota_used_pct(F.col("day_used"), F.col("rate_per_day")),
    })


def key_lifecycle(keys: DataFrame, now: Column) -> DataFrame:
    """Whether each key is active, expired, revoked, due for rotation now or in 14 days."""
    revoked = F.col("revoked_at").isNotNull()
    expired = ~revoked & F.coalesce(F.col("expires_at") <= now, F.lit(False))
    active = ~revoked & ~expired
    due = F.coalesce(F.col("rotation_due_at") <= now, F.lit(False))
    soon = F.coalesce((F.col("rotation_due_at") > now) & (F.col("rotation_due_at") <= now + F.expr("INTERVAL 14 DAYS")), F.lit(False))
    return keys.withColumns({
        "revoked": revoked, "expired": expired, "active": active,
        "rotation_due": active & due, "rotation_due_soon": active & soon,
    })


def lifecycle_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(c).alias(c) for c in ("active", "revoked", "expired", "rotation_due", "rotation_due_soon")])


def health_report(audit: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """One-row health report: audit totals, key states, status and warnings."""
    k = F.lit(1).alias("_k")
    a = status_rollup(audit).select("total", "latest_at", "ok", "rate_limited", "server_errors", k)
    l = lifecycle_counts(key_lifecycle(keys, now)).withColumnRenamed("total", "keys").select("*", k)
    warn = F.array_compact(F.array(
        F.when(F.col("active") == 0, "no active key"),
        F.when(F.col("server_errors") > 0, "audit contains server errors"),
        F.when(F.col("rate_limited") > 0, "audit contains rate-limited requests"),
        F.when(F.col("rotation_due") > 0, "active keys are due for rotation"),
        F.when(F.col("rotation_due_soon") > 0, "active keys rotate within 14 days"),
    ))
    bad = (F.col("active") == 0) | (F.col("server_errors") > 0) | (F.col("rotation_due") > 0)
    return a.join(l, "_k").drop("_k").withColumns({
        "warnings": warn, "status": F.when(bad, "warn").otherwise("ok")})


def closeout_keys(audit: DataFrame, keys: DataFrame, watchlists: DataFrame, snapshots: DataFrame,
                  alerts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per key: requests, workspace use and lifecycle over the trailing window."""
    since = now - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = F.coalesce(F.col("created_at") >= since, F.lit(False)) | F.coalesce(F.col("last_used_at") >= since, F.lit(False))
    chosen = key_lifecycle(keys.filter(recent & ~F.col("scopes").contains("admin:read")), now)
    used = status_rollup(audit.filter(F.col("at") >= since), "key_id").withColumnRenamed("total", "requests")
    w = watchlists.groupBy("key_id").agg(
        F.count(F.lit(1)).alias("watchlists"), F.count_if(F.col("created_at") >= since).alias("watchlists_created"))
    s = snapshots.groupBy("key_id").agg(F.count_if(F.col("created_at") >= since).alias("snapshots"))
    a = alerts.groupBy("key_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("status") == "open").alias("open_alerts"),
        F.count_if(F.col("first_seen_at") >= since).alias("new_alerts"))
    out = chosen
    for part in (used, w, s, a):
        out = out.join(part, "key_id", "left")
    counts = ["requests", "ok", "unauthorized", "forbidden", "rate_limited", "server_errors", "watchlists",
              "watchlists_created", "snapshots", "alerts", "open_alerts", "new_alerts"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).withColumn(
        "errors", F.col("unauthorized") + F.col("forbidden") + F.col("rate_limited") + F.col("server_errors"))


def closeout_verdict(per_key: DataFrame, key_limit: int | None = None) -> DataFrame:
    """Totals over all keys, or the ``key_limit`` used last, and the verdict."""
    top = per_key if key_limit is None else per_key.orderBy(
        F.coalesce("last_used_at", "created_at").desc(), F.col("created_at").desc(), "key_id").limit(key_limit)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = top.agg(
        F.count(F.lit(1)).alias("keys"), *[total(c) for c in (
            "requests", "ok", "server_errors", "rate_limited", "watchlists", "snapshots", "alerts", "open_alerts")],
        F.count_if(F.col("revoked") | F.col("expired") | F.col("rotation_due")).alias("lifecycle_actions"))
    adopted = (F.col("requests") >= 10) & ((F.col("watchlists") > 0) | (F.col("snapshots") > 0))
    hold = (F.col("keys") == 0) | (F.col("server_errors") > 0) | (F.col("ok") == 0)
    return t.withColumn("verdict", F.when(hold, "hold").when(F.col("lifecycle_actions") > 0, "continue")
                        .when(adopted, "expand_candidate").otherwise("continue"))


def audit_freshness(audit: DataFrame, now: Column, hours: int = 24, required: bool = False) -> DataFrame:
    """Row count, last event and pass / warn / fail against a cutoff."""
    cutoff = now - F.expr(f"INTERVAL {int(hours)} HOURS")
    return audit.agg(F.count(F.lit(1)).alias("rows"), F.max("at").alias("last_at")).withColumn(
        "status", F.when(F.col("rows") == 0, "fail" if required else "warn").when(F.col("last_at") < cutoff, "warn").otherwise("pass"))


def prune_counts(audit: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows before and after dropping those older than ``days``."""
    if days < 1:
        raise ValueError("days must be at least 1")
    kept = F.col("at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")
    return audit.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after")).withColumn(
        "deleted", F.col("before") - F.col("after"))


def keys_over_limit(watchlists: DataFrame, limit: int) -> DataFrame:
    return watchlists.groupBy("key_id").agg(F.count(F.lit(1)).alias("watchlists")).withColumn(
        "at_limit", F.col("watchlists") >= limit)


# -- telemetry -----------------------------------------------------------------------
def daily_telemetry(events: DataFrame) -> DataFrame:
    """Counters per UTC day, event kind, tool and client family. Whatever is asked later is
    a sum over these few rows."""
    from tidemark.functions.texts import client_family
    status, tool = F.col("status"), F.col("kind") == "tool"
    ms = safe_duration(F.col("duration_ms"))
    return events.groupBy(
        F.to_date("ts").alias("day"), F.when(tool, F.col("tool")).alias("tool"),
        F.when(F.col("kind") == "initialize", client_family("client")).alias("client"),
    ).agg(
        F.count_if(F.col("kind") == "http").alias("http_requests"),
        F.count_if((F.col("kind") == "http") & (status >= 500)).alias("http_5xx"),
        F.count_if((F.col("kind") == "http") & status.between(400, 499)).alias("http_4xx"),
        F.count_if((F.col("kind") == "http") & status.between(200, 299)).alias("http_2xx"),
        F.count_if(F.col("kind") == "initialize").alias("initializations"),
        F.count_if(tool).alias("tool_calls"),
        F.count_if(tool & F.col("success")).alias("tool_successes"),
        F.sum(F.when(tool, ms).otherwise(0)).alias("tool_duration_ms"),
        F.max(F.when(tool, ms).otherwise(0)).alias("tool_max_ms"),
    )


def telemetry_summary(daily: DataFrame, *keys: str) -> DataFrame:
    """Sums, success rate, average and largest latency of daily counters."""
    sums = ["http_requests", "http_2xx", "http_4xx", "http_5xx", "initializations", "tool_calls", "tool_successes", "tool_duration_ms"]
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max("tool_max_ms").alias("max_tool_latency_ms")]
    out = daily.groupBy(*keys).agg(*aggs) if keys else daily.agg(*aggs)
    calls = F.nullif("tool_calls", F.lit(0))
    return out.withColumns({
        "tool_errors": F.col("tool_calls") - F.col("tool_successes"),
        "tool_success_rate": F.round(F.try_divide("tool_successes", calls), 4),
        "average_tool_latency_ms": F.round(F.try_divide("tool_duration_ms", calls), 0).cast("long"),
    })


def telemetry_windows(daily: DataFrame, today: Column) -> DataFrame:
    """Summary of the last 7 and 30 days and of the lifetime in one pass."""
    age = F.datediff(today, "day")
    spans = F.array_compact(F.array(F.when(age < 7, "7d"), F.when(age < 30, "30d"), F.lit("lifetime")))
    return telemetry_summary(daily.withColumn("span", F.explode(spans)), "span")

"""Writes: stored filings, resolutions, feature exports and the score history.

Tables are replaced a partition at a time, so a rerun of a batch gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.params import (
    EXPORT_COLUMNS, FEATURE_SCHEMA_VERSION, FORM4_ROW_KEY, PARAMETER_HASH, SCORE_VERSION, WEIGHT_VERSION,
)


def replace_filings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows with every filing of the batch replaced as a whole."""
    kept = stored.join(batch.select("accession").distinct(), "accession", "left_anti")
    return kept.unionByName(batch)


def write_holdings(holdings: DataFrame, path: str) -> None:
    """Write holdings by quarter; only the quarters present in the data are replaced. The
    rebalance lets AQE cut a large quarter into files of the advisory size."""
    (
        holdings.hint("rebalance", "report_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("report_date").parquet(path)
    )


def upsert_funds(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """New labels win; the old manager stays when the new one is null."""
    s = stored.select("cik", F.col("label").alias("_l"), F.col("manager").alias("_m"))
    return batch.join(s, "cik", "full_outer").select(
        "cik", F.coalesce("label", "_l").alias("label"), F.coalesce("manager", "_m").alias("manager")
    )


def new_filings(index: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Filings still to fetch: all when forced, else those not stored."""
    return index if force else index.join(stored.select("accession").distinct(), "accession", "left_anti")


def merge_form4_rows(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Trades with one row per key, the newest row winning."""
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in FORM4_ROW_KEY]
    return tagged.groupBy(*FORM4_ROW_KEY).agg(
        F.max(F.struct("_new", *rest)).alias("_r")
    ).select(*FORM4_ROW_KEY, *[f"_r.{c}" for c in rest])


def write_features(rows: DataFrame, path: str, fmt: str = "csv", compression: str = "none") -> None:
    """Feature table as CSV in the fixed column order, or JSON lines with sorted keys."""
    if fmt == "csv":
        rows.select(*EXPORT_COLUMNS).write.option("header", True).csv(path, compression=compression)
    elif fmt == "jsonl":
        rows.select(*sorted(EXPORT_COLUMNS)).write.option("ignoreNullFields", False).json(path, compression=compression)
    else:
        raise ValueError("fmt must be csv or jsonl")


def feature_summary(rows: DataFrame) -> DataFrame:
    """Row count and scope of a feature table; 'mixed' when there are several scopes."""
    scope = F.nullif("feature_scope", F.lit(""))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.count_distinct(scope) > 1, "mixed").otherwise(F.coalesce(F.max(scope), F.lit(""))).alias("feature_scope"),
    )


def history_entries(scored: DataFrame, window_days: Column, source: str, recorded_at: Column,
                    code_commit: str = "unknown") -> DataFrame:
    """Score revisions to append, each with the hash of what it says. Numbers are hashed as
    text, so the hash does not depend on a float format."""
    body = F.to_json(F.struct(
        F.col("quadrant"), F.round("score", 1).cast("string").alias("score"), F.col("ticker"),
        F.lit(SCORE_VERSION).alias("version"), window_days.cast("string").alias("window_days"),
    ), {"ignoreNullFields": "false"})
    return scored.select(
        F.lit(1).alias("history_version"),
        recorded_at.alias("recorded_at"),
        F.lit(source).alias("source"),
        window_days.alias("window_days"),
        F.upper("ticker").alias("ticker"),
        F.lit(SCORE_VERSION).alias("score_version"),
        F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
        F.lit(WEIGHT_VERSION).alias("weight_version"),
        F.lit(PARAMETER_HASH).alias("parameter_hash"),
        F.lit(code_commit).alias("code_commit"),
        F.round("score", 1).alias("score"),
        "quadrant",
        F.sha2(body, 256).alias("revision_hash"),
        body.alias("signal"),
    )


def append_history(entries: DataFrame, path: str) -> None:
    """Adds entries to a score history of JSON lines; earlier ones are never rewritten."""
    entries.write.mode("append").json(path)


def keep_newest(df: DataFrame, keys: list[str], n: int, ts: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows per key; every partition keeps at most n per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def workspace_export(watchlists: DataFrame, latest: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flat export: one row per watchlist and alert, watchlists without alerts included."""
    a = alerts.select("watchlist_id", F.col("ticker").alias("alert_ticker"), F.col("action").alias("alert_action"),
                      F.col("severity").alias("alert_severity"), F.col("status").alias("alert_status"))
    s = latest.select("watchlist_id", F.col("snapshot_id").alias("latest_snapshot_id"))
    return (
        watchlists.select("watchlist_id", "key_id", "name", F.array_join("tickers", ";").alias("tickers"))
        .join(s, "watchlist_id", "left").join(a, "watchlist_id", "left")
    )


WORKSPACE = (
    "key_id string, watchlists array<struct<id: string, name: string, tickers: array<string>, "
    "latest_snapshot: struct<id: string, created_at: timestamp, signals: array<struct<ticker: string, action: string, score: double>>>, "
    "alerts: array<struct<ticker: string, action: string, severity: bigint, status: string>>>>"
)


def nested_workspaces(watchlists: DataFrame, latest: DataFrame, alerts: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """One row per key with its workspace as a nested record, built from the leaves up: signals and alerts
    per watchlist, then watchlists per key. ``signals`` (snapshot_id, ticker, action, score) are
    optional. Lists are in order of severity and ticker, score and ticker, and name."""
    entry = F.struct((-F.col("severity")).alias("_order"), "ticker", "action", F.col("severity").cast("bigint").alias("severity"), "status")
    raised = alerts.groupBy("watchlist_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("_order")).alias("alerts"))
    kind = "array<struct<ticker: string, action: string, score: double>>"
    newest = latest.select("watchlist_id", F.col("snapshot_id").alias("_id"), F.col("created_at").alias("_at"))
    if signals is None:
        newest = newest.withColumn("_signals", F.lit(None).cast(kind))
    else:
        one = F.struct((-F.col("score")).alias("_order"), "ticker", "action", "score")
        lists = signals.groupBy(F.col("snapshot_id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("_order")).alias("_signals"))
        newest = newest.join(lists, "_id", "left").withColumn("_signals", F.coalesce("_signals", F.array().cast(kind)))
    snapshot = F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("id"), F.col("_at").alias("created_at"), F.col("_signals").alias("signals")))
    whole = watchlists.join(newest, "watchlist_id", "left").join(raised, "watchlist_id", "left")
    record = F.struct("name", F.col("watchlist_id").alias("id"), "tickers", snapshot.alias("latest_snapshot"), F.coalesce("alerts", F.array()).alias("alerts"))
    sorted_ = F.array_sort(F.collect_list(F.struct("name", F.col("watchlist_id").alias("id"), record.alias("r"))), lambda a, b: F.when(
        (a["name"] < b["name"]) | ((a["name"] == b["name"]) & (a["id"] < b["id"])), -1).otherwise(1))
    return whole.groupBy("key_id").agg(F.transform(sorted_, lambda x: F.struct(
        x["r"]["id"].alias("id"), x["r"]["name"].alias("name"), x["r"]["tickers"].alias("tickers"), x["r"]["latest_snapshot"].alias("latest_snapshot"),
        x["r"]["alerts"].alias("alerts"))).alias("watchlists"))


def write_workspaces(nested: DataFrame, path: str, buckets: int = 16) -> None:
    """Workspaces as JSON, an object a line, in folders by a hash of the key, so that one key's export is
    found without reading the others."""
    nested.withColumn("bucket", F.pmod(F.xxhash64("key_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").json(path)


def read_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Exported workspaces as flat rows: one per watchlist and alert, watchlists without alerts included."""
    rows = spark.read.schema(WORKSPACE).json(path).select("key_id", F.explode("watchlists").alias("w"))
    rows = rows.select("key_id", "w.*").select("*", F.explode_outer("alerts").alias("a"))
    return rows.select("key_id", F.col("id").alias("watchlist_id"), "name", "tickers", F.col("latest_snapshot.id").alias("latest_snapshot_id"),
                       F.col("latest_snapshot.signals").alias("signals"), F.col("a.ticker").alias("alert_ticker"), F.col("a.action").alias("alert_action"),
                       F.col("a.severity").alias("alert_severity"), F.col("a.status").alias("alert_status"))

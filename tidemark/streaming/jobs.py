"""Streaming twins of the event, filing and workspace jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import watch
from tidemark.session import shared_folder


def run_available(stream: DataFrame, name: str, write_batch: Callable[[DataFrame, int], None],
                  mode: str = "update", checkpoint: str | None = None) -> None:
    """Process everything that has arrived, then stop. With the checkpoint of an earlier run
    only what is new since then; without one, everything."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write a batch to its own folder; a repeated batch overwrites itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def updates_table(stream: DataFrame, name: str, mode: str = "update", path: str | None = None) -> DataFrame:
    """Run an update-mode query and return its change log with ``batch_id``. Under the same
    ``path`` a later run goes on where the last one stopped."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, name)
    run_available(stream, name, batch_writer(f"{path}/log"), mode, f"{path}/checkpoint")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/log")


def latest_state(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last value of every key in a change log."""
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    return log.groupBy(*keys).agg(F.max(F.struct("batch_id", *rest)).alias("_s")).select(*keys, *[f"_s.{c}" for c in rest])


# -- windows on events -----------------------------------------------------------
def rate_counts(events: DataFrame, unit: str = "1 minute", late: str = "2 hours") -> DataFrame:
    """Requests per key and tumbling window; state older than the watermark is dropped."""
    return (
        events.withWatermark("at", late)
        .groupBy("key_id", F.window("at", unit).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("key_id", F.col("w.start").alias("window_start"), "count")
    )


def over_limit(counts: DataFrame, keys: DataFrame, limit: str) -> DataFrame:
    return counts.join(keys.select("key_id", F.col(limit).alias("limit")), "key_id").withColumn(
        "over_limit", F.col("count") > F.col("limit"))


def daily_counters(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tool calls per UTC day and tool."""
    return (
        events.withWatermark("ts", late).filter("kind = 'tool'")
        .groupBy(F.window("ts", "1 day").alias("w"), "tool")
        .agg(F.count(F.lit(1)).alias("tool_calls"), F.count_if("success").alias("tool_successes"),
             F.max("duration_ms").alias("tool_max_ms"))
        .select(F.to_date("w.start").alias("day"), "tool", "tool_calls", "tool_successes", "tool_max_ms")
    )


def retained_days(counters: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Days inside the retention."""
    return counters.filter(F.col("day").between(F.date_sub(today, days - 1), today))


def trailing_buyers(trades: DataFrame, window: str = "14 days", step: str = "1 day", late: str = "30 days") -> DataFrame:
    """Purchases and dollars per ticker in sliding windows over the trade time."""
    return (
        trades.withWatermark("traded_at", late)
        .filter("transaction_code = 'P' and acquired_disposed = 'A'")
        .groupBy("ticker", F.window("traded_at", window, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("buys"), F.round(F.sum(F.col("shares") * F.col("price_per_share")), 2).alias("buy_usd"))
        .select("ticker", F.to_date("w.end").alias("window_end"), "buys", "buy_usd")
    )


def audit_appends(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Audit rows, each id once."""
    return (
        events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
        .select("id", "key_id", "method", "route", "status", "at")
    )


#: Longest texts of an event's fields.
EVENT_CAPS = {"event_type": 80, "entity_type": 80, "entity_id": 120, "title": 240}


def event_appends(events: DataFrame, late: str = "2 hours", caps: dict[str, int] = EVENT_CAPS) -> DataFrame:
    """Activity and operator events, each id once, with their texts cut to what the log holds."""
    kept = events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return kept.withColumns({c: F.substring(c, 1, n) for c, n in caps.items() if c in events.columns})


# -- per-client fixed windows ---------------------------------------------------------
CLIENT_WINDOW_SCHEMA = "key_id string, requests bigint, refused bigint"


class ClientWindow(StatefulProcessor):
    """Fixed window that starts at a client's first request and restarts after it is over.

    State per client is two numbers, whatever the number of requests; with ``expire`` it ends
    when nothing has come for a window. Of a batch's requests a task holds how many came in each
    millisecond, in order of time; each window is one look-up in that, not a loop over requests.
    """

    def __init__(self, limit: int, window_ms: int, expire: bool = False):
        self.limit, self.window_ms, self.expire = limit, window_ms, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, used bigint", ttlDurationMs=self.window_ms if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start, used = self.state.get() if self.state.exists() else (None, 0)
        at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for chunk in rows:  # counted when it comes, so a client's batch is never held whole
            new_at, new_n = np.unique(chunk["at_ms"].to_numpy(), return_counts=True)
            both, place = np.unique(np.concatenate([at, new_at]), return_inverse=True)
            at, n = both, np.bincount(place, np.concatenate([n, new_n]), len(both)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        refused = done = 0
        while done < len(at):
            if start is None or at[done] - start >= self.window_ms:
                start, used = int(at[done]), 0
            end = int(np.searchsorted(at, start + self.window_ms))
            new = int(before[end] - before[done])
            refused += max(0, used + new - max(self.limit, used))
            used, done = used + new, end
        self.state.update((start, used))
        yield pd.DataFrame({"key_id": [key[0]], "requests": [int(before[-1])], "refused": [refused]})

    def close(self) -> None:
        pass


def client_windows(events: DataFrame, limit: int = 120, window_ms: int = 60_000, expire: bool = False) -> DataFrame:
    """Requests and refusals per client and batch. ``events`` has key_id and at_ms. The session
    must keep streaming state in RocksDB (``ROCKSDB``). ``expire`` drops the state of clients
    that have been silent for a window by the clock; it is for queries that run on, as Spark
    then starts batches without data too and a run over what is available would not end."""
    return events.select("key_id", "at_ms").groupBy("key_id").transformWithStateInPandas(
        ClientWindow(limit, window_ms, expire), CLIENT_WINDOW_SCHEMA, "Update", "ProcessingTime" if expire else "None")


#: Session setting for arbitrary state.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# -- filings and workspace in foreachBatch ---------------------------------------------
BUCKETS = 32


class Log:
    """An append-only table with one folder per batch, and in it one per bucket of the keys. A
    batch that runs again overwrites its own folder and reads only earlier ones, so its result
    does not change. Each batch adds what it touched; nothing old is rewritten. A look-up of
    some keys joins on their bucket too, so that Spark reads only the buckets it needs.

    The table stays under ``path``: a later run goes on with it.
    """

    def __init__(self, spark, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        self.schema = T.StructType([*empty.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
        empty.write.mode("ignore").parquet(f"{path}/batch_id=-1/bucket=0")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def read(self, upto: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return (rows if upto is None else rows.filter(F.col("batch_id") <= upto)).drop("bucket")

    def of(self, touched: DataFrame, upto: int) -> DataFrame:
        """Rows of the touched keys."""
        wanted = touched.select(*self.keys).distinct().withColumn("bucket", self.bucket())
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("batch_id") <= upto)
        return rows.join(wanted, ["bucket", *self.keys], "left_semi").drop("bucket")

    def batch(self, batch_id: int) -> DataFrame:
        return self.read().filter(F.col("batch_id") == batch_id)

    def append(self, df: DataFrame, batch_id: int) -> None:
        df.select(*self.columns).withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/batch_id={batch_id}")


def filing_alerts(filings: DataFrame, subscriptions: DataFrame, send: Callable[[DataFrame], DataFrame] | None = None,
                  path: str | None = None) -> DataFrame:
    """Stream of filings to delivery outcomes: the newest filing of every fund goes once to
    each pending subscription. ``send`` gets the pending rows and returns them with a
    ``status``; delivery is at least once, and rows recorded as sent never go again, also in
    later runs under the same ``path``. A batch looks at the funds it has filings of, and at
    those with a delivery that failed in the batch before."""
    spark = filings.sparkSession
    path = path or shared_folder(spark, "filing-alerts")
    seen = Log(spark, f"{path}/seen", "cik string, filing_date date, accession string", ["cik"])
    log = Log(spark, f"{path}/deliveries", "cik string, subscription_id string, accession string, status string", ["cik"])
    send = send or (lambda pending: pending.withColumn("status", F.lit("sent")))

    def step(batch: DataFrame, batch_id: int) -> None:
        seen.append(batch, batch_id)
        failed = log.batch(batch_id - 1).filter("status = 'failed'")
        touched = batch.select("cik").unionByName(failed.select("cik"))
        newest = seen.of(touched, batch_id).groupBy("cik").agg(
            F.max(F.struct("filing_date", "accession")).alias("f")).select("cik", "f.accession")
        pending = watch.pending_deliveries(subscriptions, log.of(touched, batch_id - 1), newest)
        log.append(send(pending), batch_id)

    run_available(filings, "filing-alerts", step, "append", f"{path}/checkpoint")
    return latest_state(log.read().drop("cik"), ["subscription_id", "accession"])


def resolved_stream(filings: DataFrame, resolve: Callable[[DataFrame], DataFrame], schema: str, path: str | None = None) -> DataFrame:
    """Resolved filing per fund and quarter, kept current as filings arrive, however late:
    only the quarters touched by a batch are decided again."""
    spark, key = filings.sparkSession, ["cik", "report_date"]
    path = path or shared_folder(spark, "resolved-filings")
    known = Log(spark, f"{path}/known", schema, key)
    chosen = Log(spark, f"{path}/resolved", schema, key)

    def step(batch: DataFrame, batch_id: int) -> None:
        known.append(batch, batch_id)
        chosen.append(resolve(known.of(batch, batch_id).drop("batch_id")), batch_id)

    run_available(filings, "resolved-filings", step, "append", f"{path}/checkpoint")
    return latest_state(chosen.read(), key)


ALERT_SCHEMA = ("key_id string, watchlist_id string, ticker string, action string, severity int, reason_score double, "
                "snapshot_id string, status string, first_seen_at timestamp, last_seen_at timestamp")


def alert_stream(candidates: DataFrame, path: str | None = None) -> DataFrame:
    """Stream of alert candidates to the alert table: first seen kept, the rest refreshed."""
    spark = candidates.sparkSession
    path = path or shared_folder(spark, "alerts")
    alerts = Log(spark, f"{path}/alerts", ALERT_SCHEMA, watch.ALERT_KEY)

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = latest_state(alerts.of(batch, batch_id - 1), watch.ALERT_KEY)
        alerts.append(watch.upsert_alerts(stored, batch), batch_id)

    run_available(candidates, "alerts", step, "append", f"{path}/checkpoint")
    return latest_state(alerts.read(), watch.ALERT_KEY)


def snapshot_run(schedule: DataFrame, flow: DataFrame, limit: int | None, now: Column) -> DataFrame:
    """One automated run: due watchlists, their signals, one snapshot row each with the
    action counts. A watchlist without signals still gets its snapshot."""
    due = watch.due_watchlists(schedule, limit).select(
        "watchlist_id", "key_id", "tickers", "actions", "moves", "min_score", "min_holders", "min_buyers", "max_13f_value_usd")
    signals = watch.watchlist_signals(due, flow)
    counts = watch.action_counts(signals, "watchlist_id")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("alerts", "watch", "monitor", "blocked")}
    return due.select("watchlist_id", "key_id").join(counts, "watchlist_id", "left").withColumns(zero).withColumn("created_at", now)

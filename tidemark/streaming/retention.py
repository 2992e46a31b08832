"""Counters and audit rows that end: state with timers, and tables that drop whole days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.texts import client_family
from tidemark.functions.values import safe_duration
from tidemark.session import materialize
from tidemark.streaming.jobs import latest_state

DAY_MS = 24 * 3600 * 1000
COUNTERS = ["calls", "successes", "duration_ms", "max_ms"]
COUNTER_SCHEMA = "kind string, name string, day date, calls bigint, successes bigint, duration_ms bigint, max_ms bigint, ended boolean"


class DayCounters(StatefulProcessor):
    """Counters of one tool or client family by day. A day's counters are an entry of their own, and a
    timer removes them when the watermark says that the day is out of the retention."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("days", "day bigint", "calls bigint, successes bigint, duration_ms bigint, max_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        touched: dict[int, list[int]] = {}
        for chunk in rows:  # a chunk is folded when it comes; what is held is a few numbers a day
            for day, g in chunk.groupby("day_no"):
                now = touched.setdefault(int(day), [0, 0, 0, 0])
                now[0] += len(g)
                now[1] += int(g["success"].sum())
                now[2] += int(g["ms"].sum())
                now[3] = max(now[3], int(g["ms"].max()))
        out = []
        for day, (calls, successes, duration, most) in sorted(touched.items()):
            if self.counts.containsKey((day,)):
                a, b, c, d = self.counts.getValue((day,))
                calls, successes, duration, most = calls + a, successes + b, duration + c, max(most, d)
            else:
                self.handle.registerTimer((day + self.days) * DAY_MS)
            self.counts.updateValue((day,), (calls, successes, duration, most))
            out.append((day, calls, successes, duration, most, False))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - self.days
        if self.counts.containsKey((day,)):
            self.counts.removeKey((day,))
            yield self.frame(key, [(day, 0, 0, 0, 0, True)])

    @staticmethod
    def frame(key, rows: list[tuple]) -> pd.DataFrame:
        days = [dt.date(1970, 1, 1) + dt.timedelta(days=r[0]) for r in rows]
        table = {"kind": [key[0]] * len(rows), "name": [key[1]] * len(rows), "day": days}
        return pd.DataFrame(table | {c: [r[i + 1] for r in rows] for i, c in enumerate([*COUNTERS, "ended"])})

    def close(self) -> None:
        pass


def counted_events(events: DataFrame) -> DataFrame:
    """Telemetry rows with what they count for: calls of a tool, or starts of a family of clients."""
    tool = F.col("kind") == "tool"
    return events.filter("kind IN ('tool', 'initialize')").select(
        "ts", F.when(tool, "tool").otherwise("client").alias("kind"), F.when(tool, F.col("tool")).otherwise(client_family("client")).alias("name"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("day_no"), F.coalesce("success", F.lit(False)).alias("success"),
        F.when(tool, safe_duration(F.col("duration_ms"))).otherwise(0).cast("bigint").alias("ms"))


def day_counters(events: DataFrame, days: int = 30, late: str = "2 days") -> DataFrame:
    """Stream of telemetry rows to a change log of daily counters by tool and client family. A day
    that is out of the retention leaves the state, and says so with an ``ended`` row.
    The session must keep streaming state in RocksDB."""
    rows = counted_events(events.withWatermark("ts", late))
    return rows.groupBy("kind", "name").transformWithStateInPandas(DayCounters(days), COUNTER_SCHEMA, "Update", "EventTime")


def live_counters(log: DataFrame) -> DataFrame:
    """Counters of the days that have not ended."""
    return latest_state(log, ["kind", "name", "day"]).filter("not ended").drop("ended")


# -- audit rows by day -------------------------------------------------------------
def write_by_day(audit: DataFrame, path: str) -> None:
    """Audit rows in a folder per UTC day; a batch adds to its days."""
    audit.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def prune_days(spark: SparkSession, path: str, cutoff: dt.datetime) -> DataFrame:
    """Drop audit rows before ``cutoff`` from a table of write_by_day(): whole days by their folders, and of
    the cutoff's own day the earlier rows. One row: before, after, deleted, and days dropped."""
    table = spark.read.parquet(path)
    count = lambda df: materialize(df.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "days")
    before = count(table)
    edge = F.lit(cutoff.date())
    old = [r["day"] for r in before.filter(F.col("day") < edge).select("day").collect()]  # one per day of the table
    kept = materialize(table.filter((F.col("day") == edge) & (F.col("at") >= F.lit(cutoff))), "edge-day")
    system = spark.sparkContext._jvm.org.apache.hadoop.fs
    for day in old:
        folder = system.Path(f"{path}/day={day}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if before.filter(F.col("day") == edge).count():
        kept.drop("day").write.mode("overwrite").parquet(f"{path}/day={cutoff.date()}")
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    left = count(spark.read.schema(table.schema).parquet(path))
    return total(before, "before").withColumns({
        "after": total(left, "after").scalar(), "days_dropped": F.lit(len(old)).cast("long"),
    }).withColumn("deleted", F.col("before") - F.col("after"))

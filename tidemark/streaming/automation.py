"""Automated snapshots of saved watchlists: each row of a stream of ticks is one run.

A run takes the watchlists that are due, matches them with the flow of its time, and commits several
tables under one batch id: the snapshots and their signals, the alerts that they open or refresh, the
difference to the snapshots before, and the activity. The row in `runs` is written last, and
readers take only batches that have one. So a run that stops half-way has done nothing, and a batch
that runs again overwrites what it wrote itself and reads only earlier ones: nothing changes.

A watchlist that can't be run, because its saved filters can't be read or it has no tickers, gives a
row with the reason, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators import watch
from tidemark.session import materialize
from tidemark.sources.writers import keep_newest
from tidemark.streaming.jobs import latest_state, run_available

# Saved filters by name, as they are stored in a watchlist's JSON text: type, and column of a filter.
FILTERS = {
    "action": ("array<string>", "f_actions"), "move": ("array<string>", "f_moves"), "min_score": ("double", "min_score"),
    "min_holders": ("int", "min_holders"), "min_buyers": ("int", "min_buyers"), "max_13f_value_usd": ("double", "max_13f_value_usd"),
}

TABLES = {
    "snapshots": "snapshot_id string, key_id string, watchlist_id string, created_at timestamp, input_count bigint, signals bigint, "
                 "alerts bigint, watch bigint, monitor bigint, blocked bigint, baseline_snapshot_id string",
    "signals": "snapshot_id string, key_id string, watchlist_id string, ticker string, action string, score double, "
               "triggers array<string>, movement_codes array<string>",
    "alerts": "key_id string, watchlist_id string, ticker string, action string, severity int, reason_score double, "
              "snapshot_id string, status string, first_seen_at timestamp, last_seen_at timestamp",
    "deltas": "snapshot_id string, key_id string, watchlist_id string, ticker string, change string, from_action string, to_action string, "
              "from_score double, to_score double, action_changed boolean, score_changed boolean",
    "activity": "key_id string, event_type string, entity_type string, entity_id string, title string, detail string, created_at timestamp",
    "outcomes": "key_id string, watchlist_id string, name string, frequency string, signals bigint, snapshot_id string, error string",
    "runs": "run_at timestamp, due bigint, processed bigint, failed bigint, ok boolean",
}


def read_filters(watchlists: DataFrame) -> DataFrame:
    """watchlists with a column for each saved filter, and `error`: why `filters` or the tickers can't be used."""
    saved = F.try_parse_json(F.coalesce(F.nullif(F.trim("filters"), F.lit("")), F.lit("{}")))
    rows = watchlists.withColumn("_saved", saved)
    problems = [F.when(F.col("_saved").isNull(), "filters are not JSON"),
                F.when(~F.schema_of_variant("_saved").startswith("OBJECT"), "filters are not an object")]
    for name, (kind, column) in FILTERS.items():
        given = F.variant_get("_saved", f"$.{name}", "variant")
        value = F.try_variant_get("_saved", f"$.{name}", kind)
        rows = rows.withColumn(column, value)
        problems.append(F.when(given.isNotNull() & ~F.is_variant_null(given) & value.isNull(), f"{name} is not {kind}"))
    tickers = F.coalesce("tickers", F.array().cast("array<string>"))
    problems.append(F.when(F.size(tickers) == 0, "no tickers"))
    return rows.withColumn("error", F.coalesce(*problems)).drop("_saved")


def preview_signals(watchlists: DataFrame, flow: DataFrame) -> DataFrame:
    """Each watchlist's tickers with their flow, as far as its filters let them pass. A ticker nobody moved is blocked."""
    wanted = watchlists.select("key_id", "watchlist_id", *(c for _, c in FILTERS.values()), F.explode("tickers").alias("ticker"))
    wanted = wanted.withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker != ''").distinct()
    seen = watch.watchlist_preview(flow, wanted)
    return wanted.join(seen, "ticker").where(watch.matches(
        F.col("f_actions"), F.col("f_moves"), F.col("min_score"), F.col("min_holders"), F.col("min_buyers"), F.col("max_13f_value_usd"),
    )).drop(*(c for _, c in FILTERS.values()))


@dataclass
class SnapshotRuns:
    """Runs over saved watchlists (key_id, watchlist_id, name, tickers, filters, enabled, frequency, updated_at) of usable keys.

    `flow_at` gives the ticker flow as of a time. Tables lie under `path`, and a later stream of ticks goes on with them.
    """

    spark: SparkSession
    path: str
    watchlists: DataFrame
    keys: DataFrame
    flow_at: Callable[[Column], DataFrame]
    most: int | None = None

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """A table's committed rows with their batch_id; with `before` those of earlier batches."""
        done = self._read("runs") if before is None else self._read("runs").where(F.col("batch_id") < before)
        return done if name == "runs" else self._read(name).join(done.select("batch_id"), "batch_id", "left_semi")

    def _read(self, name: str) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[name])
        empty.write.mode("ignore").parquet(f"{self.path}/{name}/batch_id=-1")
        schema = T.StructType([*empty.schema.fields, T.StructField("batch_id", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        where = f"{self.path}/{name}/batch_id={batch_id}"
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in columns)).write.mode("overwrite").parquet(where)
        return self.spark.read.schema(columns).parquet(where)

    def due(self, now: Column, batch_id: int) -> DataFrame:
        """Due watchlists with their filters read; `error` tells those that can't be run."""
        schedule = watch.watchlist_schedule(self.watchlists, self.keys, self.table("snapshots", batch_id), now)
        return read_filters(watch.due_watchlists(schedule, self.most))

    def run(self, now: Column, batch_id: int) -> None:
        name = F.substring(F.sha2(F.concat_ws("|", "watchlist_id", now.cast("string")), 256), 1, 16)
        due = materialize(self.due(now, batch_id).withColumn("snapshot_id", name), "due-watchlists")
        good = due.where("error IS NULL")
        signals = preview_signals(good, self.flow_at(now)).join(good.select("watchlist_id", "snapshot_id"), "watchlist_id")
        signals = self._write("signals", signals, batch_id)
        touched = good.select("key_id", "watchlist_id").distinct()

        before = self.table("snapshots", batch_id).join(touched, ["key_id", "watchlist_id"], "left_semi")
        latest = before.groupBy("key_id", "watchlist_id").agg(F.max(F.struct("created_at", "snapshot_id")).alias("_l")).select(
            "key_id", "watchlist_id", F.col("_l.snapshot_id").alias("baseline_snapshot_id"))
        counts = watch.action_counts(signals, "watchlist_id").withColumn("signals", F.expr("alerts + watch + monitor + blocked"))
        zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("signals", "alerts", "watch", "monitor", "blocked")}
        snapshots = good.withColumns({"created_at": now, "input_count": F.size("tickers")}).join(
            counts, "watchlist_id", "left").withColumns(zero).join(latest, ["key_id", "watchlist_id"], "left")
        snapshots = self._write("snapshots", snapshots, batch_id)

        earlier = self.table("signals", batch_id).join(latest, F.col("snapshot_id") == F.col("baseline_snapshot_id"), "left_semi")
        delta = watch.snapshot_delta(signals, earlier, "key_id", "watchlist_id").where("change != 'kept' OR action_changed OR score_changed")
        delta = self._write("deltas", delta.join(snapshots.select("watchlist_id", "snapshot_id"), "watchlist_id"), batch_id)

        known = self.table("alerts", batch_id)
        stored = latest_state(known.join(touched, ["key_id", "watchlist_id"], "left_semi"), watch.ALERT_KEY)
        candidates = watch.alert_candidates(signals, F.col("snapshot_id"), now)
        alerts = self._write("alerts", watch.upsert_alerts(stored, candidates), batch_id)

        outcomes = due.join(snapshots.select("watchlist_id", "signals"), "watchlist_id", "left").withColumn(
            "snapshot_id", F.when(F.col("error").isNull(), F.col("snapshot_id")))
        outcomes = self._write("outcomes", outcomes, batch_id)
        self._write("activity", self.activity(outcomes, alerts, known, delta, candidates, now), batch_id)
        total = outcomes.agg(F.count(F.lit(1)).alias("due"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        self._write("runs", total.withColumns({"run_at": now, "ok": F.col("failed") == 0}), batch_id)

    def activity(self, outcomes: DataFrame, alerts: DataFrame, known: DataFrame, delta: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
        """An event for each watchlist of the run; those of snapshots say what changed and how the key's alerts stand."""
        keys = outcomes.select("key_id").distinct()
        all_alerts = known.join(keys, "key_id", "left_semi").unionByName(alerts.withColumn("batch_id", F.lit(1 << 62)))
        by_key = latest_state(all_alerts, watch.ALERT_KEY).groupBy("key_id").agg(
            *(F.count_if(F.col("status") == s).alias(s) for s in ("open", "acknowledged", "dismissed")))
        changes = delta.groupBy("watchlist_id").agg(
            F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"),
            F.count_if("action_changed").alias("changed_actions"), F.count_if("score_changed").alias("changed_scores"))
        raised = candidates.groupBy("watchlist_id").agg(F.count(F.lit(1)).alias("candidates"))
        rows = outcomes.join(by_key, "key_id", "left").join(changes, "watchlist_id", "left").join(raised, "watchlist_id", "left")
        zero = lambda *names: F.struct(*(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names))
        done = F.to_json(F.struct(
            "snapshot_id", F.col("signals").alias("signal_count"), "frequency", zero("candidates", "open", "acknowledged", "dismissed").alias("alerts"),
            zero("added", "removed", "changed_actions", "changed_scores").alias("delta")))
        failed = F.col("error").isNotNull()
        return rows.select(
            "key_id", F.when(failed, "signals.snapshot.automation_failed").otherwise("signals.snapshot.automated").alias("event_type"),
            F.lit("watchlist").alias("entity_type"), F.col("watchlist_id").alias("entity_id"),
            F.concat(F.when(failed, "Automated snapshot failed: ").otherwise("Automated signal snapshot: "), "name").alias("title"),
            F.when(failed, F.to_json(F.struct("error"))).otherwise(done).alias("detail"), now.alias("created_at"))

    def step(self, ticks: DataFrame, batch_id: int) -> None:
        """One run for the newest tick of a batch."""
        at = ticks.agg(F.max("run_at")).first()[0]
        if at is not None:
            self.run(F.lit(at), batch_id)

    def follow(self, ticks: DataFrame) -> None:
        """Run for all ticks that have come since the last time."""
        run_available(ticks, "snapshot-runs", self.step, "append", f"{self.path}/checkpoint")

    def kept_snapshots(self, newest: int = 100) -> DataFrame:
        """Snapshots inside the retention: so many of each watchlist."""
        return keep_newest(self.table("snapshots"), ["key_id", "watchlist_id"], newest, tie="snapshot_id")

"""Registered queries on filing alerts: their messages, and their delivery through a channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import holdings, messages
from tidemark.plans.driver_tables import Tables
from tidemark.plans.workspace_queries import _as_stream, _deliveries, _newest, _subscriptions
from tidemark.session import materialize, shared_folder
from tidemark.streaming.delivery import deliver_alerts


def _messages(t: Tables):
    """The message of each fund's newest filing, by the date it was filed."""
    quarter = t.chain().select("cik", "report_date", "prev_report_date")
    newest = holdings.latest_filing_by_date(t.totals()).select("cik", "report_date", "accession", "form", "filing_date")
    newest = newest.join(quarter, ["cik", "report_date"], "left")
    # Messages count and rank the moves: those of the newest quarters are made once.
    m = t.moves(by_fund=True).drop("curr_weight").join(newest.select("cik", "report_date"), ["cik", "report_date"], "left_semi")
    m = materialize(m, "newest-moves")
    m = m.withColumns({c: F.round(c, 2) for c in ("curr_value", "prev_value")}).withColumn("share_change_pct", F.round("share_change_pct", 9))
    return messages.filing_messages(newest, m, t.funds())


def v12_alert_messages(spark, sf):
    """The whole text of every fund's newest alert, with the 15 largest moves of each class."""
    return _messages(Tables(spark, sf))


def st1_channel_deliveries(spark, sf):
    """Filings through a message channel that is down for one segment of customers in the first run."""
    t = Tables(spark, sf)
    subscriptions = materialize(_subscriptions(t), "subscriptions")
    text = materialize(_messages(t), "messages")
    done = materialize(_deliveries(t, _newest(t)).where("status IN ('sent', 'primed')"), "delivered")
    filings = _as_stream(t.totals().select("cik", "accession"), "filings")
    path = shared_folder(spark, "channel")

    def first(message: dict) -> None:
        if message["target"] == "MACHINERY":
            raise ConnectionError("channel is down")

    deliver_alerts(filings, subscriptions, text, first, path, done)
    return deliver_alerts(filings, subscriptions, text, lambda message: None, path, done)


QUERIES = {f.__name__: f for f in (v12_alert_messages, st1_channel_deliveries)}

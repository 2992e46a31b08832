"""Filing alerts through a message channel: filings and failed deliveries in, messages out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark.sources.channel import MESSAGE, OUTCOME, ChannelWriter, channel, outcomes, recover


def deliver_alerts(filings: DataFrame, subscriptions: DataFrame, messages: DataFrame, send: Callable[[dict], None], path: str,
                   already: DataFrame | None = None, writer: type[ChannelWriter] = ChannelWriter) -> DataFrame:
    """Send every filing of the stream that has a message to its fund's active subscriptions, and return
    the outcome of each (subscription, filing) with its attempts.

    ``messages`` holds the message of each fund's newest filing (cik, accession, subject, body), so a
    filing that a newer one has replaced is not sent, also not again. Deliveries that failed in an
    earlier run under the same ``path`` are a stream of their own and come again; those recorded as
    sent, or given in ``already`` (subscription_id, accession), never do.
    """
    spark = filings.sparkSession
    recover(path)
    log = outcomes(spark, path)
    done = log.filter("status = 'sent'").select("subscription_id", "accession")
    if already is not None:
        done = done.unionByName(already.select("subscription_id", "accession"))
    active = subscriptions.filter("active").select("subscription_id", "cik", "channel", "target")
    fresh = filings.select("cik", "accession").join(active, "cik")
    failed = spark.readStream.schema(OUTCOME).parquet(f"{path}/outcomes").filter("status = 'failed'")
    again = failed.select("subscription_id", "cik", "accession").join(active, ["subscription_id", "cik"])
    wanted = fresh.unionByName(again).join(messages.select("cik", "accession", "subject", "body"), ["cik", "accession"])
    pending = wanted.join(done.distinct(), ["subscription_id", "accession"], "left_anti")
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    source = channel(send, writer=writer)
    spark.dataSource.register(source)
    query = (
        pending.select(*names).writeStream.format(source.name()).option("path", path)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return delivered(outcomes(spark, path))


def delivered(log: DataFrame) -> DataFrame:
    """Outcome per (subscription, filing) over all attempts: sent once is sent."""
    return log.groupBy("subscription_id", "accession").agg(
        F.max("status").alias("status"), F.count(F.lit(1)).alias("attempts"), F.max("error").alias("error"))

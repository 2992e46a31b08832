"""Price, fundamentals and reference documents to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHART = (
    "struct<chart: struct<error: string, result: array<struct<timestamp: array<bigint>, "
    "indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<close: array<double>>>>>>>>"
)
AGGREGATES = "struct<results: array<struct<t: bigint, c: double>>>"
FUNDAMENTALS = (
    "struct<results: struct<market_cap: double, weighted_shares_outstanding: double, "
    "share_class_shares_outstanding: double>>"
)


def parse_price_csv(docs: DataFrame) -> DataFrame:
    """(ticker, date, close) from CSV bodies with a Date and a Close column. Bodies without
    a Close column ('No data') give nothing, unreadable lines are skipped."""
    lines = F.split("body", "\r?\n")
    headed = docs.select("ticker", F.split(F.get(lines, 0), ",").alias("h"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))
    field = lambda name: F.try_element_at(F.split("line", ","), F.nullif(F.array_position("h", name), F.lit(0)).cast("int"))
    return headed.select(
        "ticker",
        F.try_to_date(field("Date"), "yyyy-MM-dd").alias("date"),
        field("Close").try_cast("double").alias("adj_close"),
    ).filter("date is not null and adj_close is not null")


def parse_chart_json(docs: DataFrame) -> DataFrame:
    """(ticker, date, adj_close) from chart documents: epoch seconds to UTC days, adjusted
    closes when there are any, else plain closes; empty pairs are dropped. A document with
    an error fails the job."""
    chart = docs.select("ticker", F.from_json("json", CHART)["chart"].alias("c")).withColumn(
        "c", F.when(F.col("c.error").isNotNull(), F.raise_error(F.concat(F.lit("chart error: "), F.col("c.error")))).otherwise(F.col("c"))
    )
    result = F.get("c.result", 0)
    adjusted = F.get(result["indicators"]["adjclose"], 0)["adjclose"]
    plain = F.get(result["indicators"]["quote"], 0)["close"]
    values = F.when(F.size(F.coalesce(adjusted, F.array().cast("array<double>"))) > 0, adjusted).otherwise(plain)
    pairs = F.explode(F.arrays_zip(result["timestamp"].alias("ts"), values.alias("px")))
    return (
        chart.select("ticker", pairs.alias("p"))
        .filter("p.ts is not null and p.px is not null")
        .select("ticker", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("p.ts") / 86400).cast("int")).alias("date"),
                F.col("p.px").alias("adj_close"))
    )


def parse_aggregates_json(docs: DataFrame) -> DataFrame:
    """(ticker, date, adj_close) from aggregate documents: epoch milliseconds and close."""
    rows = docs.select("ticker", F.explode(F.from_json("json", AGGREGATES)["results"]).alias("r"))
    return rows.filter("r.t is not null and r.c is not null").select(
        "ticker", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("r.t") / 86400000).cast("int")).alias("date"),
        F.col("r.c").alias("adj_close"),
    )


def parse_fundamentals_json(docs: DataFrame) -> DataFrame:
    """(ticker, market_cap, shares_outstanding): weighted shares, else the share class count."""
    r = docs.select(F.upper("ticker").alias("ticker"), F.from_json("json", FUNDAMENTALS)["results"].alias("r"))
    return r.filter("r is not null").select(
        "ticker", F.col("r.market_cap").alias("market_cap"),
        F.coalesce(F.nullif("r.weighted_shares_outstanding", F.lit(0.0)), "r.share_class_shares_outstanding").alias("shares_outstanding"),
    )

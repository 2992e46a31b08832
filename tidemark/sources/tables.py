"""Readers for files this library or a user wrote: feature tables, history, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.values import (
    first_text, lenient_bool, lenient_date, positive_double, text,
)
from tidemark.params import EXPORT_COLUMNS

FEATURE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EXPORT_COLUMNS])


def read_feature_rows(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Feature table as text columns, from CSV or JSON lines."""
    fmt = fmt or ("json" if path.rstrip("/").endswith((".jsonl", ".json")) else "csv")
    if fmt == "json":
        return spark.read.schema(FEATURE_SCHEMA).json(path)
    return spark.read.schema(FEATURE_SCHEMA).option("header", True).csv(path)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    return parse_tickers(spark.read.text(path))


def parse_tickers(lines: DataFrame) -> DataFrame:
    """Distinct upper-case tickers of a list; blank lines and # comments are skipped."""
    t = F.upper(text("value"))
    return lines.select(t.alias("ticker")).filter("ticker <> '' and ticker not like '#%'").distinct()


def _columns(df: DataFrame, *names: str):
    found = [n for n in names if n in df.columns]
    return first_text(*found) if found else F.lit("")


def parse_adjusted_prices(rows: DataFrame) -> DataFrame:
    """(ticker, date, adj_close) from text rows under several column names; rows with a bad
    date or a price that is not positive are dropped."""
    ticker = F.upper(_columns(rows, "ticker", "symbol"))
    px = positive_double(F.nullif(_columns(rows, "adj_close", "adjusted_close", "close", "price"), F.lit("")))
    return rows.select(
        ticker.alias("ticker"), lenient_date(_columns(rows, "date")).alias("date"), px.alias("adj_close")
    ).filter("ticker <> '' and date is not null and adj_close is not null")


def read_adjusted_prices(spark: SparkSession, path: str) -> DataFrame:
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return parse_adjusted_prices(spark.read.schema(schema).option("header", True).csv(path))


def parse_form4_rows(rows: DataFrame) -> DataFrame:
    """Normalized insider trades from text rows under several column names. A missing code
    counts as a purchase, a missing price is taken from the value, and a missing filing
    date from the trade date."""
    c = lambda *names: _columns(rows, *names)
    number = lambda *names: positive_double(F.nullif(c(*names), F.lit("")))
    code = F.coalesce(F.nullif(F.upper(c("transaction_code", "code")), F.lit("")), F.lit("P"))
    side = F.nullif(F.upper(c("acquired_disposed", "transaction_acquired_disposed_code")), F.lit(""))
    shares = F.coalesce(number("shares", "transaction_shares"), F.lit(0.0))
    price = F.coalesce(number("price_per_share", "transaction_price_per_share"), F.lit(0.0))
    value = number("value_usd", "transaction_value_usd")
    issuer = c("issuer_cik")
    traded = lenient_date(c("transaction_date", "txn_date", "period_of_report"))
    return rows.select(
        F.upper(c("ticker", "issuer_ticker", "symbol")).alias("ticker"),
        F.when(issuer != "", F.lpad(issuer, 10, "0")).otherwise("").alias("issuer_cik"),
        c("issuer_name").alias("issuer_name"),
        c("accession", "form4_accession").alias("accession"),
        F.coalesce(lenient_date(c("filing_date", "accepted_at", "acceptance_date")), traded).alias("filing_date"),
        traded.alias("transaction_date"),
        c("owner_cik", "reporting_owner_cik").alias("owner_cik"),
        c("owner_name", "reporting_owner_name").alias("owner_name"),
        c("officer_title", "role").alias("officer_title"),
        lenient_bool(c("is_officer")).alias("is_officer"),
        lenient_bool(c("is_director")).alias("is_director"),
        lenient_bool(c("is_ten_percent_owner")).alias("is_ten_percent_owner"),
        code.alias("transaction_code"),
        F.coalesce(side, F.when(code == "P", "A").when(code == "S", "D").otherwise("")).alias("acquired_disposed"),
        F.coalesce(F.nullif(c("security_title", "title_of_class"), F.lit("")), F.lit("Common Stock")).alias("security_title"),
        shares.alias("shares"),
        F.when((price <= 0) & value.isNotNull() & (shares > 0), F.try_divide(value, shares)).otherwise(price).alias("price_per_share"),
        F.coalesce(number("shares_owned_after"), F.lit(0.0)).alias("shares_owned_after"),
        (~F.upper(c("direct", "ownership_nature")).startswith("I")).alias("direct"),
    ).filter("ticker <> '' and transaction_date is not null")


HISTORY_SCHEMA = (
    "seq bigint, history_version int, recorded_at string, generated_at string, source string, window_days int, "
    "ticker string, score_version string, feature_schema_version string, weight_version string, "
    "parameter_hash string, code_commit string, score double, quadrant string, revision_hash string, "
    "signal string, _corrupt_record string"
)


def parse_signal_history(lines: DataFrame, limit: int | None = None, ticker: str | None = None,
                         window_days: int | None = None) -> DataFrame:
    """Good records of a score history, newest first; with a ``limit``, the last so many. Lines
    that are not JSON are skipped."""
    parsed = lines.select(F.from_json("value", HISTORY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("h"))
    good = parsed.filter("h._corrupt_record is null and h is not null").select("h.*").drop("_corrupt_record")
    if ticker:
        good = good.filter(F.col("ticker") == ticker.upper())
    if window_days is not None:
        good = good.filter(F.coalesce("window_days", F.lit(0)) == window_days)
    newest = good.orderBy(F.col("seq").desc())
    return newest if limit is None else newest.limit(limit)

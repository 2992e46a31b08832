"""What a feature table proves: scope, coverage, row errors and the review verdict.

Rows come as read from a file, so every column may be text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.texts import split_list
from tidemark.functions.values import finite_double, lenient_date, split_of, text
from tidemark.params import (
    FEATURE_SCHEMA_VERSION, HORIZONS, PARAMETER_HASH, RECOMMENDED_COLUMNS, REQUIRED_COLUMNS,
    SCOPE_JOINED, SCORE_VERSION, WEIGHT_VERSION,
)

RETURNS = [f"forward_return_{h}d" for h in HORIZONS]
VERSIONS = {
    "score_version": SCORE_VERSION,
    "feature_schema_version": FEATURE_SCHEMA_VERSION,
    "weight_version": WEIGHT_VERSION,
    "parameter_hash": PARAMETER_HASH,
}


def _ticker() -> Column:
    return F.nullif(F.upper(text("ticker")), F.lit(""))


def _evidence_sums() -> list[Column]:
    has_filings = F.size(split_list("form4_accessions")) > 0
    buyers = F.coalesce(finite_double("open_market_buyers"), F.lit(0.0)) > 0
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(_ticker()).alias("ticker_count"),
        F.count_if(text("feature_scope") == SCOPE_JOINED).alias("joined_rows"),
        F.count_if(has_filings).alias("rows_with_form4_accessions"),
        F.count_distinct(F.when(has_filings, _ticker())).alias("tickers_with_form4_accessions"),
        F.count_if(buyers).alias("rows_with_open_market_buyers"),
        F.count_distinct(F.when(buyers, _ticker())).alias("tickers_with_open_market_buyers"),
        F.round(F.coalesce(F.sum(finite_double("open_market_buy_value_usd")), F.lit(0.0)), 2).alias("open_market_buy_value_usd"),
        *[F.count(finite_double(c)).alias(f"{c}_rows") for c in RETURNS],
    ]


def _with_coverage(sums: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(f"{c}_rows").cast("double"), F.col("row_count")), 6), F.lit(0.0))
    return sums.withColumns({f"{c}_coverage": share(c) for c in RETURNS})


def evidence(rows: DataFrame) -> DataFrame:
    """One row: how many rows and tickers carry insider filings, buyers and returns."""
    return _with_coverage(rows.agg(*_evidence_sums()))


def evidence_counts(rows: DataFrame) -> DataFrame:
    """Long rows (section, key, n): scopes, quality flags and calendar splits."""
    scope = F.coalesce(F.nullif(text("feature_scope"), F.lit("")), F.lit("unknown"))
    entries = F.flatten(F.array(
        F.array(F.struct(F.lit("feature_scope").alias("section"), scope.alias("key"))),
        F.array(F.struct(F.lit("split").alias("section"), split_of(lenient_date("as_of")).alias("key"))),
        F.transform(split_list("data_quality_flags"), lambda f: F.struct(F.lit("data_quality_flag").alias("section"), f.alias("key"))),
    ))
    return rows.select(F.explode(entries).alias("e")).groupBy("e.section", "e.key").agg(F.count(F.lit(1)).alias("n"))


def _errors_of_row(rows: DataFrame) -> Column:
    """What is wrong with a row: (field, error) of missing values, bad dates and bad numbers."""
    present = [c for c in REQUIRED_COLUMNS if c in rows.columns]
    blank = lambda c: text(c) == ""
    error = lambda cond, field, name: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(name).alias("error")))
    checks = [error(blank(c), c, "missing_value") for c in present]
    checks.append(error(lenient_date("as_of").isNull(), "as_of", "invalid_date"))
    checks += [
        error(~blank(c) & finite_double(c).isNull(), c, "not_numeric")
        for c in ("score", *RETURNS) if c in present
    ]
    return F.array_compact(F.array(*checks))


def _mismatches_of_row(rows: DataFrame) -> Column:
    """Stamps of a row that are not the expected ones: (field, value)."""
    return F.array_compact(F.array(*[
        F.when((text(c) != "") & (text(c) != expected), F.struct(F.lit(c).alias("field"), text(c).alias("value")))
        for c, expected in VERSIONS.items() if c in rows.columns
    ]))


def row_errors(rows: DataFrame) -> DataFrame:
    """Long rows (field, error, n) of missing values, bad dates and bad numbers."""
    return rows.select(F.explode(_errors_of_row(rows)).alias("e")).groupBy("e.field", "e.error").agg(F.count(F.lit(1)).alias("n"))


def version_mismatches(rows: DataFrame) -> DataFrame:
    """Long rows (field, value, n) of stamps that are not the expected ones."""
    return rows.select(F.explode(_mismatches_of_row(rows)).alias("e")).groupBy("e.field", "e.value").agg(F.count(F.lit(1)).alias("n"))


def _manifest_sums(rows: DataFrame) -> list[Column]:
    """The manifest's figures, all from one pass over the rows."""
    d = lenient_date("as_of")
    total = lambda array, name: F.coalesce(F.sum(F.size(array)), F.lit(0)).cast("long").alias(name)
    return [
        F.min(d).alias("date_from"), F.max(d).alias("date_to"),
        total(_errors_of_row(rows), "row_error_count"), total(_mismatches_of_row(rows), "version_mismatch_count"),
    ]


def _manifest_status(sums: DataFrame, columns: list[str]) -> DataFrame:
    out = sums.withColumns({
        "missing_required_columns": F.lit(";".join(c for c in REQUIRED_COLUMNS if c not in columns)),
        "missing_recommended_columns": F.lit(";".join(c for c in RECOMMENDED_COLUMNS if c not in columns)),
    })
    valid = (
        (F.col("row_count") > 0) & (F.col("missing_required_columns") == "")
        & (F.col("version_mismatch_count") == 0) & (F.col("row_error_count") == 0)
    )
    return out.withColumn("status", F.when(valid, "valid_minimum_schema").otherwise("not_publishable"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row: size, date range, missing columns, errors, and whether the minimum schema holds."""
    sums = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(_ticker()).alias("ticker_count"), *_manifest_sums(rows))
    return _manifest_status(sums, rows.columns)


def evidence_review(rows: DataFrame) -> DataFrame:
    """Blockers, warnings and verdict from the manifest and the evidence."""
    both = _manifest_status(_with_coverage(rows.agg(*_evidence_sums(), *_manifest_sums(rows))), rows.columns)
    blockers = F.array_compact(F.array(
        F.when(F.col("status") != "valid_minimum_schema", "minimum_schema_not_valid"),
        F.when(F.col("joined_rows") == 0, "no_13f_form4_joined_rows"),
        F.when(F.col("rows_with_form4_accessions") == 0, "no_visible_form4_accessions"),
        F.when(F.col("rows_with_open_market_buyers") == 0, "no_open_market_form4_buyers"),
        *[F.when(F.col(f"{c}_coverage") < 1.0, f"incomplete_{c}") for c in RETURNS],
    ))
    warnings = F.array_compact(F.array(F.when(F.col("row_count") < 100, "sample_below_100_rows")))
    return both.select(blockers.alias("blockers"), warnings.alias("warnings")).withColumn(
        "status",
        F.when(F.size("blockers") > 0, "blocked")
        .when(F.size("warnings") > 0, "smoke_passed_needs_larger_sample")
        .otherwise("mechanical_evidence_ready_for_review"),
    )


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and the xor and sum of row hashes. A row's
    hash is the first 52 bits of the md5 of its values as text, in the order of the columns' names."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)))
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("sum_hash"),
    )

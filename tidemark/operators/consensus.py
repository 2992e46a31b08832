"""What many funds hold or do at the same time, and how far tickers are resolved.

Lists collected here hold one label per fund, so they are bounded by the number of
filers, not by the number of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.moves import BUYS


def has_ticker() -> Column:
    return F.coalesce(F.col("ticker"), F.lit("")) != ""


def restrict_funds(df: DataFrame, ciks: DataFrame | None) -> DataFrame:
    """Keep the given funds. None keeps all, an empty set keeps nothing."""
    return df if ciks is None else df.join(ciks.select("cik").distinct(), "cik", "left_semi")


def consensus_holdings(snapshots: DataFrame, funds: DataFrame, min_funds: int = 3) -> DataFrame:
    """Securities held long by at least ``min_funds`` funds in a quarter. A fund has one
    resolved filing per quarter and one long row per security, so rows are funds."""
    long = snapshots.filter("put_call = ''").join(funds.select("cik", "label"), "cik")
    return (
        long.groupBy("report_date", "cusip")
        .agg(
            F.max("ticker").alias("ticker"),
            F.max("issuer").alias("issuer"),
            F.count(F.lit(1)).alias("n_funds"),
            F.sum("value_usd").alias("total_value"),
            F.array_sort(F.collect_set("label")).alias("funds"),
        )
        .filter(F.col("n_funds") >= min_funds)
    )


def consensus_moves(moves: DataFrame, funds: DataFrame, kinds: tuple[str, ...] = BUYS,
                    min_funds: int = 3) -> DataFrame:
    """Securities on which at least ``min_funds`` fund labels made a move of ``kinds``.
    A label votes once; its move is the one of its smallest cik."""
    votes = (
        moves.filter((F.col("put_call") == "") & F.col("move").isin(*kinds))
        .join(funds.select("cik", "label"), "cik")
        .groupBy("report_date", "cusip", "label")
        .agg(
            F.min_by("move", "cik").alias("move"),
            F.max("ticker").alias("ticker"),
            F.min("issuer").alias("issuer"),
        )
    )
    voted = F.array_sort(F.collect_list(F.struct("label", "move")))
    return (
        votes.groupBy("report_date", "cusip")
        .agg(
            F.max("ticker").alias("ticker"),
            F.min("issuer").alias("issuer"),
            F.count(F.lit(1)).alias("n_funds"),
            voted.alias("votes"),
        )
        .filter(F.col("n_funds") >= min_funds)
    )


def holders(snapshots: DataFrame, funds: DataFrame, *keep: str) -> DataFrame:
    """Which funds hold each security long, with value, shares and weight."""
    return (
        snapshots.filter("put_call = ''")
        .join(funds.select("cik", "label"), "cik")
        .select("report_date", "cusip", *keep, "cik", F.col("label").alias("fund"),
                "value_usd", "shares", "weight")
    )


def coverage(snapshots: DataFrame, funds: DataFrame) -> DataFrame:
    """Ticker coverage of long positions per fund and, in the row without a cik, overall."""
    value = F.coalesce("value_usd", F.lit(0.0))
    long = snapshots.filter("put_call = ''").join(funds.select("cik", "label"), "cik")
    return (
        long.rollup("cik")
        .agg(
            F.min("label").alias("fund"),
            F.max("report_date").alias("report_date"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(has_ticker()).alias("n_res"),
            F.sum(value).alias("val"),
            F.sum(F.when(has_ticker(), value).otherwise(0.0)).alias("val_res"),
        )
        .withColumn("fund", F.when(F.col("cik").isNotNull(), F.col("fund")))
        .withColumn("value_share", F.try_divide("val_res", F.nullif("val", F.lit(0.0))))
        .withColumn("value_unresolved", F.col("val") - F.col("val_res"))
    )


def coverage_by_source(positions: DataFrame) -> DataFrame:
    """Resolved long value of each filing by where the ticker came from."""
    return (
        positions.filter((F.col("put_call") == "") & has_ticker())
        .groupBy("accession", F.coalesce("ticker_source", F.lit("?")).alias("ticker_source"))
        .agg(F.count(F.lit(1)).alias("n_resolved"), F.sum("value_usd").alias("value_resolved"))
    )


def unresolved_tail(snapshots: DataFrame) -> DataFrame:
    """Long securities without a ticker, with value and number of funds."""
    return (
        snapshots.filter((F.col("put_call") == "") & ~has_ticker())
        .groupBy("cusip")
        .agg(
            F.max("issuer").alias("issuer"),
            F.sum("value_usd").alias("value"),
            F.count_distinct("cik").alias("n_funds"),
        )
    )


def compare_funds(snapshots: DataFrame, ciks: DataFrame, max_funds: int = 12) -> DataFrame:
    """Overlap of a few chosen funds: shared securities, Jaccard index and common weight.
    More than ``max_funds`` of them fail the job, as pairs are made within a security. Each security is folded to one map of the few chosen holders, so
    a pair of funds meets once per shared security at most."""
    few = ciks.select("cik").distinct().groupBy().agg(F.collect_set("cik").alias("c"))
    checked = F.when(F.size("c") > max_funds, F.raise_error(F.lit(f"more than {max_funds} funds to compare"))).otherwise(F.col("c"))
    chosen = few.select(F.explode(checked).alias("cik"))
    held = snapshots.filter("put_call = ''").join(F.broadcast(chosen), "cik", "left_semi")
    sizes = held.groupBy("cik").agg(F.count(F.lit(1)).alias("n"))
    per_security = held.groupBy("cusip").agg(
        F.array_sort(F.collect_list(F.struct("cik", "weight"))).alias("h")
    )
    pair = F.explode(
        F.flatten(
            F.transform(
                "h",
                lambda a: F.transform(
                    F.filter("h", lambda b: b["cik"] > a["cik"]),
                    lambda b: F.struct(
                        a["cik"].alias("cik_a"), b["cik"].alias("cik_b"),
                        F.least(a["weight"], b["weight"]).alias("w"),
                    ),
                ),
            )
        )
    )
    pairs = (
        per_security.select(pair.alias("p"))
        .groupBy("p.cik_a", "p.cik_b")
        .agg(F.count(F.lit(1)).alias("common"), F.sum("p.w").alias("common_weight"))
    )
    a = sizes.toDF("cik_a", "n_a")
    b = sizes.toDF("cik_b", "n_b")
    return (
        pairs.join(F.broadcast(a), "cik_a").join(F.broadcast(b), "cik_b")
        .withColumn("jaccard", F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")))
    )

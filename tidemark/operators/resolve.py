"""Security id to ticker, with where the answer came from and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.texts import normalize_name

# Confidence of each kind of answer, and the cache rules.
CONFIDENCE = {
    "manual": 1.0, "openfigi": 0.95, "cusip_prefix": 0.85,
    "cusip_prefix_other_name": 0.65, "sec_name": 0.6, "none": 0.0,
}
NEGATIVE_TTL_DAYS = 30
KEEP_CONFIDENCE = 0.5
SIBLING_CONFIDENCE = 0.9


def needs_query(now: Column, ticker: Column, confidence: Column, resolved_at: Column) -> Column:
    """A cached answer is asked again when it is weak or missing and older than the limit."""
    solid = (F.coalesce(ticker, F.lit("")) != "") & (confidence >= KEEP_CONFIDENCE)
    age = now.cast("timestamp") - F.expr(f"INTERVAL {NEGATIVE_TTL_DAYS} DAYS")
    return ~solid & (resolved_at.isNull() | (resolved_at <= age))


def name_index(companies: DataFrame) -> DataFrame:
    """Normalized title to (ticker, title). ``file_order`` decides between equal names;
    names shorter than three characters are left out."""
    norm = companies.withColumn("norm", normalize_name("title")).filter(F.length("norm") >= 3)
    return norm.groupBy("norm").agg(
        F.min_by(F.struct("ticker", "title"), "file_order").alias("_c")
    ).select("norm", "_c.ticker", "_c.title")


def ticker_cik_map(companies: DataFrame) -> DataFrame:
    """Ticker to ten-digit cik, first of the file wins."""
    ticker = F.upper(F.trim("ticker"))
    cik = F.trim(F.col("cik_str").cast("string"))
    return (
        companies.select(ticker.alias("ticker"), cik.alias("cik"), "file_order")
        .filter("ticker <> '' and cik <> ''")
        .groupBy("ticker")
        .agg(F.lpad(F.min_by("cik", "file_order"), 10, "0").alias("cik"))
    )


def select_instruments(candidates: DataFrame) -> DataFrame:
    """One instrument per id from a list of candidates: equities first, then common
    stock, then list order. Rows of the pass with an exchange code (``pass_no`` 1) win;
    the second pass only answers for ids the first one missed."""
    equity = F.coalesce(F.col("market_sector") == "Equity", F.lit(False))
    common = F.coalesce(F.col("security_type").contains("Common"), F.lit(False))
    key = F.struct(
        F.col("pass_no"),
        F.when(equity, 0).otherwise(1).alias("_e"),
        F.when(common, 0).otherwise(1).alias("_c"),
        F.col("pos"),
    )
    best = F.struct(
        "ticker", "name", F.coalesce("composite_figi", "figi").alias("figi"),
        "security_type", "market_sector",
    )
    return candidates.groupBy(F.upper("cusip").alias("cusip")).agg(
        F.min_by(best, key).alias("_b")
    ).select("cusip", "_b.*")


def resolve_chain(items: DataFrame, cache: DataFrame, overrides: DataFrame, mapping: DataFrame,
                  names: DataFrame, now: Column) -> DataFrame:
    """Ticker for each (cusip, issuer): a solid or fresh cached answer, else a manual
    override, else the mapping service, else a confident sibling with the same first
    six characters, else the normalized name, else a recorded miss.

    All lookups are keyed equi joins on one row per key, so AQE may broadcast the small
    ones and split skewed keys of the item side.
    """
    asked = (
        items.filter(F.coalesce("cusip", F.lit("")) != "")
        .groupBy(F.upper("cusip").alias("cusip"))
        .agg(F.max(F.coalesce("issuer", F.lit(""))).alias("issuer"))
    )
    answer = lambda ticker, name, figi, source, confidence: F.struct(
        ticker.alias("ticker"), name.alias("name"), figi.alias("figi"),
        F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"),
        (F.lit(float(confidence)) if isinstance(confidence, float) else confidence).alias("confidence"),
    )
    null = F.lit(None).cast("string")
    cached = cache.select(
        F.upper("cusip").alias("cusip"),
        answer(F.col("ticker"), F.col("name"), F.col("figi"), F.col("source"), F.col("confidence")).alias("cached"),
        needs_query(now, F.col("ticker"), F.col("confidence"), F.col("resolved_at")).alias("stale"),
    )
    manual = overrides.select(
        F.upper("cusip").alias("cusip"),
        answer(F.col("ticker"), F.col("name"), null, "manual", CONFIDENCE["manual"]).alias("manual"),
    )
    mapped = mapping.filter(F.coalesce("ticker", F.lit("")) != "").select(
        F.upper("cusip").alias("cusip"),
        answer(F.col("ticker"), F.col("name"), F.col("figi"), "openfigi", CONFIDENCE["openfigi"]).alias("mapped"),
    )
    direct = (
        asked.join(cached, "cusip", "left").join(manual, "cusip", "left").join(mapped, "cusip", "left")
        .withColumn("hit", F.coalesce(F.when(~F.col("stale"), F.col("cached")), "manual", "mapped"))
        .withColumn("tier", F.when(~F.col("stale"), 0).when(F.col("manual").isNotNull(), 1).otherwise(2))
        .select("cusip", "issuer", "hit", "tier")
    )
    confident = lambda a: (F.coalesce(a["ticker"], F.lit("")) != "") & (a["confidence"] >= SIBLING_CONFIDENCE)
    pool = (
        direct.filter("hit is not null").select("cusip", F.col("hit").alias("a"), "tier")
        .unionByName(cached.select("cusip", F.col("cached").alias("a"), F.lit(3).alias("tier")))
        .filter(confident(F.col("a")))
    )
    siblings = pool.groupBy(F.substring("cusip", 1, 6).alias("prefix")).agg(
        F.min_by(F.struct("a.ticker", "a.name"), F.struct("tier", "cusip")).alias("sibling")
    )
    by_name = names.select("norm", F.struct("ticker", "title").alias("named"))
    keyed = (
        direct.withColumn("prefix", F.substring("cusip", 1, 6))
        .withColumn("norm", normalize_name("issuer"))
        .join(siblings, "prefix", "left")
        .join(by_name.filter(F.length("norm") >= 3), "norm", "left")
    )
    same_name = F.col("norm") == normalize_name(F.col("sibling.name"))
    prefix_hit = answer(
        F.col("sibling.ticker"), F.col("sibling.name"), null, "cusip_prefix",
        F.when(same_name, CONFIDENCE["cusip_prefix"]).otherwise(CONFIDENCE["cusip_prefix_other_name"]),
    )
    name_hit = answer(F.col("named.ticker"), F.col("named.title"), null, "sec_name", CONFIDENCE["sec_name"])
    miss = answer(null, F.nullif("issuer", F.lit("")), null, "none", CONFIDENCE["none"])
    return keyed.select(
        "cusip", "issuer",
        F.coalesce(
            "hit",
            F.when(F.col("sibling").isNotNull(), prefix_hit),
            F.when(F.col("named").isNotNull(), name_hit),
            miss,
        ).alias("r"),
    ).select("cusip", "issuer", "r.*")


def apply_resolutions(holdings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Fill ticker and provenance on rows without a ticker; an old name stays when the
    new one is null. Adds ``backfilled``."""
    r = resolutions.filter(F.coalesce("ticker", F.lit("")) != "").select(
        "cusip", F.col("ticker").alias("_t"), F.col("name").alias("_n"),
        F.col("source").alias("_s"), F.col("confidence").alias("_c"),
    )
    open_row = F.coalesce(F.col("ticker"), F.lit("")) == ""
    fill = open_row & F.col("_t").isNotNull()
    return (
        holdings.join(r, "cusip", "left")
        .withColumn("backfilled", fill)
        .withColumn("ticker_source", F.when(fill, F.col("_s")).otherwise(F.col("ticker_source")))
        .withColumn("ticker_confidence", F.when(fill, F.col("_c")).otherwise(F.col("ticker_confidence")))
        .withColumn("figi_name", F.when(fill, F.coalesce("_n", "figi_name")).otherwise(F.col("figi_name")))
        .withColumn("ticker", F.when(fill, F.col("_t")).otherwise(F.col("ticker")))
        .drop("_t", "_n", "_s", "_c")
    )


def enrich_positions(positions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Attach ticker and provenance to long positions; options stay as they are."""
    bare = positions.drop("ticker", "figi_name", "ticker_source", "ticker_confidence")
    r = resolutions.filter(F.coalesce("ticker", F.lit("")) != "").select(
        "cusip", "ticker", F.col("name").alias("figi_name"),
        F.col("source").alias("ticker_source"), F.col("confidence").alias("ticker_confidence"),
    )
    cond = (F.upper(bare["cusip"]) == r["cusip"]) & (bare["put_call"] == "")
    return bare.join(r, cond, "left").drop(r["cusip"])


def portfolio_tail(positions: DataFrame, n: int | None = None) -> DataFrame:
    """Unresolved long positions of each filing by size; with ``n``, the largest so many."""
    order = Window.partitionBy("accession").orderBy(F.col("value_usd").desc(), "cusip")
    ranked = positions.filter("put_call = '' and coalesce(ticker, '') = ''").withColumn("tail_rank", F.row_number().over(order))
    return ranked if n is None else ranked.filter(F.col("tail_rank") <= n)

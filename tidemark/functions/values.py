"""Lenient parsing and small arithmetic on columns.

ANSI mode is on by default, so every parse of outside text uses a ``try_`` form.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.params import DEFAULT_FEATURES, FeatureParams, SPLITS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Trimmed text, never null."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def first_text(*names: Column | str) -> Column:
    """First of several alias columns that is not blank, else ''."""
    return F.coalesce(*[F.nullif(text(n), F.lit("")) for n in names], F.lit(""))


# -- numbers ---------------------------------------------------------------
def lenient_double(c: Column | str) -> Column:
    """Number with optional thousands commas; null when it is not one."""
    return F.regexp_replace(text(c), ",", "").try_cast("double")


def finite_double(c: Column | str) -> Column:
    value = col(c).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def positive_double(c: Column | str) -> Column:
    value = col(c).try_cast("double")
    return F.when(F.isnan(value), None).when(value > 0, value)


def lenient_bool(c: Column | str) -> Column:
    return F.lower(text(c)).isin("1", "true", "yes", "y")


def saturating(n: Column, half: Column | float) -> Column:
    """n / (n + half): 0 at and below zero, one half at ``half``."""
    half = half if isinstance(half, Column) else F.lit(float(half))
    return F.when(n > 0, n / (n + half)).otherwise(F.lit(0.0))


def signed_saturating(n: Column, half: float) -> Column:
    return F.signum(n.cast("double")) * saturating(F.abs(n), half)


def recency(days: Column, halflife: float) -> Column:
    return F.when(days <= 0, F.lit(1.0)).otherwise(
        F.pow(F.lit(0.5), days / F.lit(max(halflife, 1e-6)))
    )


def stake_increase(shares: Column, owned_after: Column) -> Column:
    """Growth of the owner's position by one buy, at most 3.0; null if the prior is unknown."""
    prior = owned_after - shares
    return F.when(prior > 0, F.least(shares / prior, F.lit(3.0)))


def sizing_multiplier(stake: Column, p: FeatureParams = DEFAULT_FEATURES) -> Column:
    grown = F.lit(p.sizing_floor) + F.lit(p.sizing_ceiling - p.sizing_floor) * saturating(
        stake, p.sizing_midpoint_pct
    )
    return F.when(stake.isNull() | (stake <= 0), F.lit(1.0)).otherwise(grown)


def seniority_multiplier(
    is_c_suite: Column, is_officer: Column, is_owner: Column, p: FeatureParams = DEFAULT_FEATURES
) -> Column:
    return (
        F.when(is_c_suite, F.lit(p.seniority_csuite))
        .when(is_officer, F.lit(p.seniority_officer))
        .when(is_owner, F.lit(p.seniority_owner))
        .otherwise(F.lit(p.seniority_director))
    )


def trade_value(shares: Column, price: Column) -> Column:
    return F.round(shares * price, 2)


def quota_remaining(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.greatest(limit - used, F.lit(0))).otherwise(F.lit(0)).cast("long")


def quota_used_pct(used: Column, limit: Column) -> Column:
    return F.round(F.try_divide(used.cast("double"), F.nullif(limit, F.lit(0))) * 100.0, 2)


def safe_count(c: Column, maximum: int = 2**53 - 1) -> Column:
    """Non-negative whole number, else 0, with an upper bound."""
    value = c.try_cast("double")
    good = (value >= 0) & (value == F.floor(value)) & (value <= float(2**53 - 1))
    return F.when(good, F.least(value, F.lit(float(maximum)))).otherwise(0.0).cast("long")


def safe_duration(c: Column) -> Column:
    """Milliseconds between 0 and one minute."""
    value = c.try_cast("double")
    good = (value >= 0) & ~F.isnan(value) & (value < float("inf"))
    return F.when(good, F.least(F.round(value), F.lit(60000.0))).otherwise(0.0).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# -- dates -----------------------------------------------------------------
def lenient_date(c: Column | str) -> Column:
    """ISO date or timestamp text (the first ten characters decide), else null."""
    raw = text(c)
    return F.coalesce(
        F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"),
        F.when(raw.rlike("^[0-9]{8}$"), F.try_to_date(raw, "yyyyMMdd")),
    )


def split_of(as_of: Column) -> Column:
    """Research split of a date: train / validation / test / outside / invalid."""
    out = F.when(as_of.isNull(), F.lit("invalid"))
    for name, (low, high) in SPLITS.items():
        out = out.when(as_of.between(F.lit(low).cast("date"), F.lit(high).cast("date")), F.lit(name))
    return out.otherwise(F.lit("outside"))


def minute_bucket(ts: Column) -> Column:
    return F.concat(F.lit("m:"), F.date_format(ts, "yyyyMMddHHmm"))


def day_bucket(ts: Column) -> Column:
    return F.concat(F.lit("d:"), F.date_format(ts, "yyyyMMdd"))

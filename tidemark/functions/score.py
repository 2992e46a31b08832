"""The 0..100 agreement score of fund accumulation and insider buying.

Everything is a column expression. A weight may be a constant or a column, so the
same expression scores one weight set or a whole grid of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.texts import short_usd
from tidemark.functions.values import clamp, recency, saturating, signed_saturating
from tidemark.params import DEFAULT_FEATURES, DEFAULT_WEIGHTS

# Columns the score reads, with the value a missing side counts as.
INSTITUTIONAL_DEFAULTS = {
    "funds_accumulating": 0,
    "funds_trimming": 0,
    "conviction_funds": 0,
    "avg_weight_pct": 0.0,
    "total_value_usd": 0.0,
    "quarters_ago": 0,
}
INSIDER_DEFAULTS = {
    "n_buyers": 0,
    "n_sellers": 0,
    "n_c_suite_buyers": 0,
    "recent_cluster_n": 0,
    "conviction_units": 0.0,
    "recency_weighted_buy_usd": 0.0,
    "buy_value_usd": 0.0,
    "sell_value_usd": 0.0,
    "max_stake_increase_pct": 0.0,
}

# Display names of the quadrants.
QUADRANT_LABELS = {
    "conviction": "Conviction",
    "institutional": "Institutional bid",
    "insider": "Insider conviction",
    "distribution": "Distribution",
    "divergent": "Divergent",
    "neutral": "Neutral",
}


def fill_missing_side(df: DataFrame) -> DataFrame:
    """Neutral values for whichever side a ticker lacks."""
    defaults = {**INSTITUTIONAL_DEFAULTS, **INSIDER_DEFAULTS}
    out = df
    for name, value in defaults.items():
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
        else:
            out = out.withColumn(name, F.lit(value))
    if "days_since_last_buy" not in df.columns:
        out = out.withColumn("days_since_last_buy", F.lit(None).cast("int"))
    return out


def pillars(weights: Mapping[str, Column | float] | None = None) -> dict[str, Column]:
    """Contribution of every pillar to the score."""
    raw = DEFAULT_WEIGHTS.as_dict() if weights is None else dict(weights)
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in raw.items()}
    c = F.col

    breadth_boost = (
        F.lit(1.0)
        + 0.5 * saturating(c("conviction_funds"), 2.0)
        + 0.5 * F.least(F.lit(1.0), c("avg_weight_pct") / 5.0)
    )
    age = F.pow(F.lit(0.6), F.greatest(c("quarters_ago"), F.lit(0)).cast("double"))
    institutional = (
        w["institutional_breadth"]
        * saturating(c("funds_accumulating") * breadth_boost, w["breadth_half"])
        * age
    )
    insider = w["insider_cluster"] * saturating(c("conviction_units"), w["cluster_half"])

    dollars = c("recency_weighted_buy_usd")
    ceiling = (
        F.log10(w["dollar_ceiling"] + 1)
        if isinstance(raw["dollar_ceiling"], Column)
        else F.lit(math.log10(raw["dollar_ceiling"] + 1))
    )
    dollar = F.when(
        dollars > 0,
        F.least(w["dollar_conviction"] * F.log10(dollars + 1) / ceiling, w["dollar_conviction"]),
    ).otherwise(F.lit(0.0))

    fresh = recency(
        F.coalesce(c("days_since_last_buy"), F.lit(999)), DEFAULT_FEATURES.recency_halflife_days
    )
    agreement = F.when(
        (c("funds_accumulating") > 0) & (c("n_buyers") > 0),
        w["agreement_bonus"]
        * (0.5 + 0.5 * F.greatest(fresh, saturating(c("recent_cluster_n"), 1.0))),
    ).otherwise(F.lit(0.0))

    trim = F.when(
        c("funds_trimming") > c("funds_accumulating"),
        w["institutional_trim_penalty"] * saturating(c("funds_trimming"), 3.0),
    ).otherwise(F.lit(0.0))
    sell = F.when(
        (c("sell_value_usd") > c("buy_value_usd")) & (c("sell_value_usd") > 0),
        w["insider_sell_penalty"] * saturating(c("n_sellers"), 2.0),
    ).otherwise(F.lit(0.0))
    return {
        "institutional_score": institutional,
        "insider_score": insider,
        "dollar_score": dollar,
        "agreement_score": agreement,
        "penalty_score": -(trim + sell),
    }


def quadrant() -> Column:
    net_funds = F.col("funds_accumulating") - F.col("funds_trimming")
    net_value = F.col("buy_value_usd") - F.col("sell_value_usd")
    funds_buy = (F.col("funds_accumulating") > 0) & (net_funds >= 0)
    funds_sell = net_funds < 0
    insiders_buy = (F.col("n_buyers") > 0) & (net_value >= 0)
    insiders_sell = (net_value < 0) & (F.col("sell_value_usd") > 0)
    return (
        F.when(funds_buy & insiders_buy, "conviction")
        .when(funds_sell & insiders_sell, "distribution")
        .when((funds_buy & insiders_sell) | (funds_sell & insiders_buy), "divergent")
        .when(funds_buy, "institutional")
        .when(insiders_buy, "insider")
        .otherwise("neutral")
    )


#: Why a ticker sits in its quadrant, in words of our own. Braces name what is put in; see rationale().
RATIONALES = {
    "conviction": "Both sides buy: {funds} fund(s) built up while {buyers} insider(s) spent {bought}{top}{fresh}.",
    "distribution": "Both sides sell: funds cut back and insiders sold {sold}.",
    "divergent": "Funds and insiders point in opposite directions.",
    "institutional": "{funds} fund(s) built up; insiders have not bought.",
    "insider": "{buyers} insider(s) spent {bought}{fresh}; funds have not followed.",
    "neutral": "Neither side builds up.",
}


def rationale(quadrant_col: Column, texts: Mapping[str, str] = RATIONALES) -> Column:
    """One sentence on why a ticker sits in its quadrant, from ``texts`` by quadrant.

    {funds}, {buyers}, {bought} and {sold} are counts and dollars; {top} names buyers of the first rank and
    {fresh} the age of the last buy, where there are any."""
    parts = {
        "funds": F.col("funds_accumulating").cast("string"),
        "buyers": F.col("n_buyers").cast("string"),
        "bought": short_usd(F.col("buy_value_usd")),
        "sold": short_usd(F.col("sell_value_usd")),
        "top": F.when(F.col("n_c_suite_buyers") > 0, F.concat(
            F.lit(", "), F.col("n_c_suite_buyers").cast("string"), F.lit(" of them at the top"))).otherwise(""),
        "fresh": F.when(F.col("days_since_last_buy").isNotNull() & (F.col("n_buyers") > 0), F.concat(
            F.lit(", last "), F.col("days_since_last_buy").cast("string"), F.lit(" day(s) before"))).otherwise(""),
    }

    def sentence(text: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", text)
        return F.concat(*(F.coalesce(parts[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)))

    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(quadrant_col == name, sentence(text)).otherwise(out)
    return out


def add_score(df: DataFrame, weights: Mapping[str, Column | float] | None = None) -> DataFrame:
    """Add pillars, score, quadrant and the x/y position of each row."""
    parts = pillars(weights)
    out = fill_missing_side(df).withColumns(parts)
    total = sum((F.col(name) for name in parts), F.lit(0.0))
    return out.withColumns(
        {
            "score": clamp(total, 0.0, 100.0),
            "quadrant": quadrant(),
            "net_funds": F.col("funds_accumulating") - F.col("funds_trimming"),
            "x": signed_saturating(F.col("funds_accumulating") - F.col("funds_trimming"), 3.0),
            "y": signed_saturating(F.col("n_buyers") - F.col("n_sellers"), 2.0),
        }
    )


def quadrant_label(c: Column) -> Column:
    out = None
    for key, label in QUADRANT_LABELS.items():
        out = F.when(c == key, label) if out is None else out.when(c == key, label)
    return out

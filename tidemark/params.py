"""Parameters of the jobs.

The numbers, names and date ranges below are fixed values: results only match
the published score contract when they are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class FeatureParams:
    """What is measured on an insider trade."""

    recency_halflife_days: float = 30.0
    recent_window_days: int = 14
    sizing_floor: float = 0.70
    sizing_ceiling: float = 1.60
    sizing_midpoint_pct: float = 0.10
    seniority_csuite: float = 1.60
    seniority_officer: float = 1.20
    seniority_owner: float = 1.10
    seniority_director: float = 1.00


@dataclass(frozen=True)
class Weights:
    """How the two sides are folded into one 0..100 score."""

    institutional_breadth: float = 36.0
    insider_cluster: float = 36.0
    dollar_conviction: float = 18.0
    agreement_bonus: float = 18.0
    institutional_trim_penalty: float = 14.0
    insider_sell_penalty: float = 14.0
    breadth_half: float = 1.5
    cluster_half: float = 1.2
    dollar_ceiling: float = 25_000_000.0

    def with_(self, **changes: float) -> "Weights":
        return replace(self, **changes)

    def as_dict(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


# The weights a search may move, and how far.
TUNABLE_BOUNDS = {
    "institutional_breadth": (10.0, 50.0),
    "insider_cluster": (10.0, 50.0),
    "dollar_conviction": (0.0, 35.0),
    "agreement_bonus": (0.0, 35.0),
    "institutional_trim_penalty": (0.0, 30.0),
    "insider_sell_penalty": (0.0, 30.0),
}

DEFAULT_FEATURES = FeatureParams()
DEFAULT_WEIGHTS = Weights()

# Stamps written on every feature row.
SCORE_VERSION = "confluence_v1"
FEATURE_SCHEMA_VERSION = "confluence_features_v1"
WEIGHT_VERSION = "heuristic_default_v1"
PARAMETER_HASH = "c5bf5faef27cd75b36f16aaded40fd860024f71317373f0ccadd209acfb6084c"
SCOPE_JOINED = "13f_form4_joined"
SCOPE_13F_ONLY = "13f_only_no_form4"

# Calendar splits of the research protocol.
SPLITS = {
    "train": ("2014-01-01", "2022-12-31"),
    "validation": ("2023-01-01", "2024-12-31"),
    "test": ("2025-01-01", "2026-12-31"),
}

# Forward-return horizons in trading rows, and job defaults.
HORIZONS = (20, 60, 120)
FORM4_WINDOW_DAYS = 90
PRECOMPUTE_WINDOWS = (30, 90, 180)
DOLLARS_EFFECTIVE = "2023-01-03"
HOLD_EPSILON = 0.005
CONVICTION_WEIGHT = 0.05

# Quality thresholds.
AUM_JUMP_THRESHOLD = 100.0
UNIT_RATIO_LOW = 800.0
UNIT_RATIO_HIGH = 1200.0
UNIT_MAX_NEIGHBOR_RATIO = 5.0
PARTIAL_AMENDMENT_MAX_POSITIONS = 3
SIGNAL_QUARTER_MIN_FUNDS = 5
SIGNAL_QUARTER_MIN_SHARE = 0.10
STATUS_RANK = {"trusted": 0, "degraded": 1, "stale": 2, "quarantined": 3}

# Columns of the exported feature table, in file order.
EXPORT_COLUMNS = [
    "as_of", "report_date", "ticker", "issuer_name", "score_version",
    "feature_schema_version", "weight_version", "parameter_hash", "code_commit",
    "feature_scope", "score", "quadrant", "institutional_score", "insider_score",
    "funds_accumulating", "funds_trimming", "net_funds", "conviction_funds",
    "avg_weight_pct", "total_value_usd", "fund_labels", "fund_moves",
    "open_market_buyers", "open_market_buy_value_usd", "13f_accession_hash",
    "13f_accessions", "form4_accession_hash", "form4_accessions", "price_source",
    "execution_timestamp", "adjusted_entry_price", "adjusted_exit_price",
    "forward_return_20d", "forward_return_60d", "forward_return_120d",
    "dollar_volume", "market_cap", "sector", "beta", "data_quality_flags",
]
REQUIRED_COLUMNS = [
    "as_of", "ticker", "score_version", "feature_schema_version", "weight_version",
    "parameter_hash", "score", "quadrant", "forward_return_20d",
    "forward_return_60d", "forward_return_120d",
]
RECOMMENDED_COLUMNS = [
    "issuer_name", "institutional_score", "insider_score", "funds_accumulating",
    "funds_trimming", "conviction_funds", "avg_weight_pct", "total_value_usd",
    "open_market_buyers", "open_market_buy_value_usd", "13f_accession_hash",
    "form4_accession_hash", "price_source", "execution_timestamp",
    "adjusted_entry_price", "adjusted_exit_price", "dollar_volume", "market_cap",
    "sector", "beta", "data_quality_flags",
]

# The score each research baseline ranks by.
BASELINES = {
    "full_score": "score",
    "insider_only": "insider_score",
    "institutional_only": "institutional_score",
    "fund_count_only": "funds_accumulating",
}
QUADRANT_RANK = {
    "conviction": 4.0,
    "institutional_only": 3.0,
    "insider_only": 2.0,
    "divergent": 1.0,
    "distribution": 0.0,
}

# The normalized insider-trade table.
FORM4_COLUMNS = [
    "ticker", "issuer_cik", "issuer_name", "accession", "filing_date",
    "period_of_report", "transaction_date", "owner_cik", "owner_name",
    "officer_title", "is_officer", "is_director", "is_ten_percent_owner",
    "transaction_code", "acquired_disposed", "security_title", "shares",
    "price_per_share", "value_usd", "shares_owned_after", "direct",
]
FORM4_ROW_KEY = [
    "ticker", "accession", "owner_cik", "transaction_date", "transaction_code",
    "acquired_disposed", "shares", "price_per_share",
]

"""Constants and the two small configuration tables (actions, policies).

Every number that decides something lives here once. The two tables are built
from the tuples below, so their row count is known before they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: must equal the published constants for equal results -----------


@dataclass(frozen=True)
class Settings:
    # ledger
    z: float = 1.96
    p_min: float = 0.82
    risk_appetite: float = 0.04
    borrow_weight: float = 0.10
    min_own_observations: int = 30
    age_halflife_days: int = 90
    trip_failures: int = 3
    trip_window: int = 100
    recover_clean: int = 50
    # gate
    k: float = 2.0
    review_cost: float = 40.0
    invariant_threshold: float = 0.5
    forced_review_rate: float = 0.0033
    default_prior: float = 0.05
    max_regenerate: int = 2
    # drift
    bins: int = 10
    drift_min_observations: int = 100
    psi_short: float = 0.20
    psi_long: float = 0.30
    psi_drift: float = 0.25
    reanchor_psi_long_max: float = 0.10
    psi_floor: float = 1e-6
    # calibration
    ece_global_max: float = 0.05
    ece_close_call_max: float = 0.08
    min_region_n: int = 100
    migrate_carry_max: float = 0.02
    migrate_halve_max: float = 0.05
    shadow_min_days: int = 30
    shadow_min_outcomes: int = 500
    test_fraction: float = 0.20
    crossfit_blocks: int = 5
    # text
    flush_tokens: int = 32
    # point-in-time length feature
    length_min_rows: int = 30
    # record
    refund_window_days: int = 30
    # corpus validation
    null_envelope: float = 0.05
    label_rate_min: float = 0.03
    label_rate_max: float = 0.25
    band_min_rows: int = 150
    stability_psi_max: float = 0.10
    stability_min_rows: int = 200
    stability_min_values: int = 50
    judge_min_pairs: int = 50
    judge_min_rho: float = 0.3
    judge_min_deciles: int = 3
    judge_sample: int = 50
    judge_max_violations: int = 1
    # run reports
    latency_p50_max: float = 40.0
    latency_p99_max: float = 500.0
    firing_min: float = 0.02
    firing_max: float = 0.05
    latency_min_requests: int = 1000
    # cost model
    monthly_volume: int = 10_000
    judge_call_cost: float = 0.11
    judge_in_per_mtok: float = 0.60
    judge_out_per_mtok: float = 2.20
    # operational log
    decisions_page_max: int = 1000


SETTINGS = Settings()

DAY_US = 86_400_000_000

# (name, lower bound inclusive, upper bound exclusive); the last one is closed on top
BANDS: tuple[tuple[str, float, float], ...] = (
    ("0-2k", 0.0, 2_000.0),
    ("2k-10k", 2_000.0, 10_000.0),
    ("10k-50k", 10_000.0, 50_000.0),
    ("50k+", 50_000.0, 200_000.0),
)
BAND_NAMES = tuple(name for name, _, _ in BANDS)
OVER_LIMIT = "over_limit"
UNPRICED = "unpriced"

EVIDENCE_WEIGHTS: dict[str, float] = {
    "record_verification": 1.00,
    "human_override": 1.00,
    "reversal": 0.90,
    "user_rework": 0.30,
    "offline_judge": 0.50,
}
OUTCOMES = ("clean", "wrong")
NON_EXECUTING_ACTIONS = ("no_action", "escalate")
REGIONS = ("act", "close_call", "escalate")
JUDGE_VERDICTS = ("correct", "questionable", "wrong")

# action, takes an amount, base amount, then (number, payload field) per multiplier,
# hard limit, horizon in seconds
ACTIONS = (
    ("issue_refund", True, None, 0.30, None, 1.20, None, 1.00, None, 200000.0, 2592000),
    ("send_bulk_email", False, 500.0, 0.95, None, 2.00, None, None, "recipient_count", 50000.0, 86400),
)
ACTION_SCHEMA = (
    "action string, has_amount boolean, base_amount double, "
    "reversibility double, reversibility_field string, "
    "visibility double, visibility_field string, "
    "blast_radius double, blast_field string, hard_limit double, horizon_sec bigint"
)

POLICIES = (
    ("fast", 1.25, "disabled", 1.0),
    ("adaptive", 1.0, "close_calls", 2.0),
    ("deep", 0.65, "side_effects", 2.0),
)
POLICY_SCHEMA = "policy_mode string, budget_multiplier double, tier2_mode string, policy_k double"

HEDGE_WORDS = (
    "might", "maybe", "possibly", "perhaps", "probably", "seems", "appears",
    "likely", "unlikely", "could", "roughly", "approximately", "around",
    "believe", "think", "unclear", "unsure", "generally", "typically", "usually",
)

# the feature contract: name, can it be unavailable
FEATURES: tuple[tuple[str, bool], ...] = (
    ("verify_fail_frac", True),
    ("verify_n_claims", True),
    ("retrieval_support_min", True),
    ("retrieval_support_mean", True),
    ("tool_retry_count", False),
    ("tool_error_count", False),
    ("hedge_density", False),
    ("length_z", True),
    ("logprob_mean", True),
    ("logprob_min", True),
    ("pii_score", True),
    ("injection_score", True),
    ("policy_score", True),
    ("secret_score", False),
    ("judge_p_wrong", True),
)
FEATURE_NAMES = tuple(name for name, _ in FEATURES)
CAN_BE_UNAVAILABLE = frozenset(name for name, can in FEATURES if can)
CAPABILITY_TIERS: dict[str, tuple[str, ...]] = {
    "full": FEATURE_NAMES,
    "topk": FEATURE_NAMES,
    "none": tuple(n for n in FEATURE_NAMES if not n.startswith("logprob")),
}

RUNG_HUMAN_TIME = {0: "none", 1: "none", 2: "none", 3: "none", 4: "~15 s", 5: "minutes", 6: "none"}

SENSOR_STACK = {
    "tier0": "t0-v1",
    "tier1": "t1-v1",
    "tier2_model": "glm-4.7",
    "tier2_thinking": "disabled",
}

# sampling mix over the order pools
INTENT_MIX = (
    ("legit_duplicate", 0.30),
    ("non_duplicate_misread", 0.15),
    ("already_refunded", 0.10),
    ("out_of_policy_age", 0.15),
    ("ambiguous", 0.25),
    ("adversarial", 0.05),
)
# --- end of fixed values -----------------------------------------------------------


MAX_CONFIG_ROWS = 10_000  # the configuration tables are broadcast


def _config_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    rows = list(rows)
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"{len(rows)} configuration rows are too many to broadcast")
    return spark.createDataFrame(rows, schema)


def action_table(spark: SparkSession, actions=ACTIONS) -> DataFrame:
    """Risk surface per action; one row per configured action."""
    return _config_table(spark, actions, ACTION_SCHEMA)


def policy_table(spark: SparkSession, policies=POLICIES) -> DataFrame:
    """Policy overlays; one row per configured mode."""
    return _config_table(spark, policies, POLICY_SCHEMA)


def band_table(spark: SparkSession, action: str) -> DataFrame:
    """The bands of an action; one row per band."""
    rows = [(action, name, low, high) for name, low, high in BANDS]
    return spark.createDataFrame(rows, "action string, band string, band_low double, band_max double")

"""Explicit schemas of every table this library reads or writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

# identifiers are text, as agents and the system of record write them
ORDER = "order_id string, customer_id string, amount_paise bigint, status string, placed_us bigint, delivered_us bigint"
CHARGE = "charge_id string, order_id string, amount_paise bigint, charged_us bigint"
REFUND = "refund_id string, order_id string, amount_paise bigint, status string, issued_us bigint, reason string"
CUSTOMER = "id string, name string, email string, created_us bigint"

CLAIMS = "struct<order_id:string,duplicate_charge:boolean,refund_amount_paise:bigint,already_refunded:boolean>"
ACTION = "struct<type:string,amount_paise:bigint,order_id:string>"
FACTS = (
    "struct<order_id:string,amount_paise:bigint,status:string,has_duplicate:boolean,"
    "already_refunded:boolean,within_window:boolean>"
)
TURN = (
    "turn_id string, ts double, order_id string, scenario string, band string, sampling_weight double, "
    f"retrieved_chunks array<string>, prompt string, reply_text string, claims {CLAIMS}, action {ACTION}, "
    f"raw_response string, agent_model string, outcome string, outcome_reasons array<string>, facts {FACTS}"
)
JUDGEMENT = "turn_id string, model string, thinking string, p_wrong double, verdict string, reasons array<string>"

DECISION = (
    "id string, ts_us bigint, agent_id string, action string, band string, fingerprint string, "
    "calibrator_version string, capability_tier string, features string, claims string, p_wrong double, "
    "challenger_p_wrong double, tier_reached int, exposure double, budget double, expected_loss double, "
    "verdict string, region string, rung int, outcome string, outcome_source string, outcome_us bigint, "
    "horizon_us bigint, latency_ms double, upstream_ms double, degraded_mode boolean, degraded_reason string, "
    "shadow boolean, forced_review boolean"
)
# what the live path writes; outcome columns are filled later, shadow columns elsewhere
LOGGED = (
    "id", "ts_us", "agent_id", "action", "band", "fingerprint", "calibrator_version", "capability_tier",
    "features", "p_wrong", "tier_reached", "exposure", "budget", "expected_loss", "verdict", "region", "rung",
    "horizon_us", "latency_ms", "upstream_ms", "forced_review", "degraded_mode", "degraded_reason",
)
TRUST = (
    "agent_id string, action string, band string, fingerprint string, n_total double, n_clean double, "
    "n_reversed double, n_own_raw bigint, p_lo double, budget double, ceiling double, state string, "
    "tripped_at bigint, clean_since_trip bigint, psi_short double, psi_long double, psi_drift double, "
    "b_short_ref string, b_long_ref string, updated_at bigint"
)
OUTCOME_EVENT = (
    "event_id bigint, decision_id string, reported_us bigint, outcome string, source string, weight double, "
    "processed_us bigint"
)
DRIFT_LOG = (
    "run_us bigint, agent_id string, action string, band string, psi_short double, psi_long double, "
    "psi_drift double, ece_act double, ece_close_call double, ece_escalate double, n_observations bigint, "
    "verdict string, action_taken string, detail string"
)
REGISTRY = (
    "version string, created_us bigint, promoted_us bigint, ready_us bigint, state string, promotion_path string, "
    "runtime_version string, capability_tier string, ece_global double, ece_close_call double, "
    "ece_delta_close_call double, rows_carried bigint, rows_halved bigint, rows_reset bigint, "
    "artifact_sha256 string, notes string"
)
BASELINE = (
    "id bigint, calibrator_version string, effective_us bigint, source string, agent_id string, action string, "
    "band string, b_short string, ece_baselines string"
)
CHUNK = "response_id string, seq int, chunk string, ts timestamp, is_last boolean"

OPERATIONAL = {
    "decision": DECISION,
    "trust_row": TRUST,
    "outcome_event": OUTCOME_EVENT,
    "drift_check_log": DRIFT_LOG,
    "calibrator_registry": REGISTRY,
    "model_baseline": BASELINE,
}
RECORD = {"customer": CUSTOMER, "order": ORDER, "charge": CHARGE, "refund": REFUND}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)

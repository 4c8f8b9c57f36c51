"""Invariants, verdict, region, rung and reason as column expressions.

Batch jobs and streams both call these, so the two cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlake.config import NON_EXECUTING_ACTIONS, RUNG_HUMAN_TIME, SETTINGS


def failed_invariants(
    pii: Column,
    injection: Column,
    secret: Column,
    amount: Column,
    hard_limit: Column,
    retrieval_scope: Column | None = None,
    user_scope: Column | None = None,
) -> Column:
    """Names of the failed checks. A missing score fails its check."""
    limit = SETTINGS.invariant_threshold
    checks = [
        (pii.isNull() | (pii >= limit), "no_pii_egress"),
        (injection.isNull() | (injection >= limit), "no_prompt_injection"),
        (secret.isNull() | (secret >= limit), "no_secrets_in_output"),
    ]
    if retrieval_scope is not None and user_scope is not None:
        wider = F.coalesce(retrieval_scope, F.lit(0)) > F.coalesce(user_scope, F.lit(0))
        checks.append((wider, "within_authorisation_scope"))
    checks.append((F.coalesce(amount > hard_limit, F.lit(False)), "within_hard_amount_limit"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))


def decide(
    p_wrong: Column, exposure: Column, budget: Column, violated: Column, k: Column | float = SETTINGS.k
) -> Column:
    """block / act / check_harder / escalate.

    A missing exposure has no price and blocks; a missing probability counts as 1.
    """
    factor = F.lit(float(k)) if isinstance(k, (int, float)) else k
    loss = F.coalesce(p_wrong, F.lit(1.0)) * exposure
    return (
        F.when(violated | exposure.isNull(), F.lit("block"))
        .when(exposure <= SETTINGS.review_cost, F.lit("act"))
        .when(loss <= budget, F.lit("act"))
        .when(loss <= budget * factor, F.lit("check_harder"))
        .otherwise(F.lit("escalate"))
    )


def region_of(verdict: Column) -> Column:
    return (
        F.when(verdict == "check_harder", F.lit("close_call"))
        .when(verdict == "act", F.lit("act"))
        .otherwise(F.lit("escalate"))
    )


def is_executing(action: Column) -> Column:
    return ~action.isin(*NON_EXECUTING_ACTIONS)


def severity(expected_loss: Column, budget: Column) -> Column:
    return expected_loss / F.greatest(budget, F.lit(1e-9))


def select_rung(
    pii: Column, secret: Column, injection: Column, verify_fail: Column,
    localised: Column, sev: Column, side_effect: Column,
) -> Column:
    """Rung of the response ladder (0..6); a missing score counts as 1."""
    def seen(score: Column) -> Column:
        return F.coalesce(score, F.lit(1.0))

    return (
        F.when((seen(pii) > 0.5) | (seen(secret) > 0.5), F.when(localised, 2).otherwise(5))
        .when(seen(injection) > 0.5, F.lit(6))
        .when(seen(verify_fail) > 0, F.when(sev < 3, 3).otherwise(5))
        .when(side_effect, F.when(sev < 3, 4).otherwise(5))
        .otherwise(F.when(sev < 2, 1).otherwise(5))
    )


def rung_for_verdict(verdict: Column, selected: Column) -> Column:
    return F.when(verdict == "block", F.lit(6)).when(verdict == "act", F.lit(0)).otherwise(selected)


def human_time(rung: Column) -> Column:
    expr = F.lit(None).cast("string")
    for value, label in RUNG_HUMAN_TIME.items():
        expr = F.when(rung == value, F.lit(label)).otherwise(expr)
    return expr


def regenerate_next(attempts: Column) -> Column:
    return F.when(attempts < SETTINGS.max_regenerate, F.lit(3)).otherwise(F.lit(5))


def _money(value: Column) -> Column:
    """Two decimals, as printf would print them."""
    return F.format_string("%.2f", value)


def decision_reason(verdict: Column, action: Column, band: Column, p: Column, exposure: Column, budget: Column) -> Column:
    # fixed values: the reason texts
    loss = F.concat(F.lit("expected loss "), _money(p * exposure))
    earned = F.concat(F.lit("earned budget "), _money(budget))
    return (
        F.when(
            (verdict == "act") & (exposure <= SETTINGS.review_cost),
            F.lit("action exposure is below the cost of human review"),
        )
        .when(verdict == "act", F.concat(loss, F.lit(" is within "), earned, F.lit(" for "), action, F.lit(" in "), band))
        .when(
            verdict == "check_harder",
            F.concat(loss, F.lit(" is close enough to "), earned, F.lit(" for deeper verification")),
        )
        .when(verdict == "block", F.lit("a fixed safety invariant failed; earned trust cannot override it"))
        .otherwise(F.concat(loss, F.lit(" exceeds "), earned, F.lit("; human control is retained")))
    )


def hash_fraction_hit(key: Column, rate: float) -> Column:
    """Replay-stable coin flip: the first 32 bits of md5(key) below ``rate`` of their range."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return bits < F.lit(int(rate * 2**32))

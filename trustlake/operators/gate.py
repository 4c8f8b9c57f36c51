"""The release gate over a table of proposed actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import (
    CAPABILITY_TIERS,
    NON_EXECUTING_ACTIONS,
    OUTCOMES,
    SETTINGS,
    action_table,
    policy_table,
)
from trustlake.functions import decision as dec
from trustlake.functions import ledger, pricing
from trustlake.operators.ranking import running_sums

TRUST_KEYS = ("agent_id", "action", "band", "fingerprint")


def price(decisions: DataFrame, actions: DataFrame | None = None, payload: Column | None = None) -> DataFrame:
    """Add ``exposure``, ``ceiling``, ``hard_limit`` and ``horizon_sec``.

    Declining actions have no side effect, so their exposure is 0. An executing
    action without an entry, or without the payload field its price names, has
    no price: its exposure stays NULL and the gate blocks it.
    """
    idle = F.col("action").isin(*NON_EXECUTING_ACTIONS)
    terms = decisions if "has_amount" in decisions.columns else pricing.with_action_terms(decisions, actions)
    return terms.withColumns(
        {
            "exposure": F.when(idle, F.lit(0.0)).otherwise(pricing.exposure(F.col("amount"), payload)),
            "ceiling": pricing.ceiling(F.col("band"), payload),
        }
    ).drop(*pricing.TERM_COLUMNS)


def reject_unpriced(decisions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an executing action must be registered."""
    known = actions.select("action", F.lit(True).alias("_known"))
    flagged = decisions.join(known, "action", "left")
    fine = F.col("action").isin(*NON_EXECUTING_ACTIONS) | F.col("_known").isNotNull()
    return flagged.filter(fine).drop("_known"), flagged.filter(~fine).drop("_known")


def lookup_budget(decisions: DataFrame, trust: DataFrame) -> DataFrame:
    """Earned budget of the decision's four-part key; no row means no budget.

    The trust table has one row per key, so a key that many decisions share only
    skews the decision side, which adaptive execution splits (or avoids, when the
    measured size of the trust side allows a broadcast).
    """
    rows = trust.select(*TRUST_KEYS, F.col("budget").alias("_budget"))
    return (
        decisions.join(rows, list(TRUST_KEYS), "left")
        .withColumn("earned_budget", F.coalesce("_budget", F.lit(0.0)))
        .drop("_budget")
    )


def apply_policy(decisions: DataFrame, policies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions with ``budget`` and ``policy_k``, decisions with an unknown mode)."""
    dim = policies if policies is not None else F.broadcast(policy_table(decisions.sparkSession))
    joined = decisions.join(dim, "policy_mode", "left")
    known = joined.filter(F.col("policy_k").isNotNull()).withColumn(
        "budget", F.col("earned_budget") * F.col("budget_multiplier")
    )
    return known, joined.filter(F.col("policy_k").isNull()).select(*decisions.columns)


def with_invariants(decisions: DataFrame) -> DataFrame:
    """Add ``failed`` (array of check names) and ``violated``."""
    scopes = ("retrieval_scope", "user_scope")
    scope_columns = [F.col(c) if c in decisions.columns else None for c in scopes]
    failed = dec.failed_invariants(
        F.col("pii_score"), F.col("injection_score"), F.col("secret_score"),
        F.col("amount"), F.col("hard_limit"), *scope_columns,
    )
    return decisions.withColumn("failed", failed).withColumn("violated", F.size("failed") > 0)


def with_verdict(decisions: DataFrame, k: Column | float = SETTINGS.k) -> DataFrame:
    """Add ``verdict`` and the ``region`` stamped from this first verdict."""
    verdict = dec.decide(F.col("p_wrong"), F.col("exposure"), F.col("budget"), F.col("violated"), k)
    return decisions.withColumn("verdict", verdict).withColumn("region", dec.region_of(F.col("verdict")))


def resolve_tier2(decisions: DataFrame, judgements: DataFrame, model_b: Column | None = None) -> DataFrame:
    """The deeper check: whom it is run on, and the one re-decision after it.

    ``judgements`` has one row per decision ``id`` with ``judge_p`` (NULL where no
    valid answer came) and ``degraded_reason``. ``model_b`` turns the joined row
    into the second probability; by default the judge's own one is used.
    """
    joined = decisions.join(
        judgements.select("id", "judge_p", F.col("degraded_reason").alias("_why")), "id", "left"
    )
    forced = (
        (F.col("tier2_mode") == "side_effects")
        & dec.is_executing(F.col("action"))
        & F.coalesce(F.col("exposure") > SETTINGS.review_cost, F.lit(False))
        & ~F.col("violated")
    )
    fires = (F.col("tier2_mode") != "disabled") & ((F.col("verdict") == "check_harder") | forced)
    judged = F.col("judge_p").isNotNull()
    second = model_b if model_b is not None else F.col("judge_p")
    p = F.when(F.col("_fires") & judged, second).otherwise(F.col("p_wrong"))
    again = dec.decide(F.col("p_wrong"), F.col("exposure"), F.col("budget"), F.col("violated"), 1.0)
    return (
        joined.withColumn("_forced", forced)
        .withColumn("_fires", fires)
        .withColumn("tier_reached", F.when(F.col("_fires"), 2).otherwise(1))
        .withColumn(
            "tier2_trigger",
            F.when(F.col("_fires"), F.when(F.col("_forced"), "deep_policy").otherwise("close_call")),
        )
        .withColumn("p_wrong", p)
        .withColumn(
            "degraded_reason",
            F.when(F.col("_fires") & ~judged, F.coalesce("_why", F.lit("TIER2_TIMEOUT"))),
        )
        .withColumn(
            "verdict",
            F.when(~F.col("_fires"), F.col("verdict"))
            .when(F.col("_forced") & ~judged, F.lit("escalate"))
            .otherwise(again),
        )
        .drop("_forced", "_fires", "_why")
    )


def forced_review(decisions: DataFrame, rate: float = SETTINGS.forced_review_rate, key: str = "id") -> DataFrame:
    """Escalate a replay-stable random share of the acts. ``region`` keeps the gate's own choice."""
    hit = (F.col("verdict") == "act") & dec.hash_fraction_hit(F.col(key), rate)
    return decisions.withColumn("forced_review", hit).withColumn(
        "verdict", F.when(F.col("forced_review"), "escalate").otherwise(F.col("verdict"))
    )


def with_rung(decisions: DataFrame) -> DataFrame:
    localised = F.col("localised") if "localised" in decisions.columns else F.lit(False)
    selected = dec.select_rung(
        F.col("pii_score"), F.col("secret_score"), F.col("injection_score"), F.col("verify_fail_frac"),
        localised,
        dec.severity(F.coalesce(F.col("p_wrong") * F.col("exposure"), F.lit(0.0)), F.col("budget")),
        dec.is_executing(F.col("action")),
    )
    return decisions.withColumn("rung", dec.rung_for_verdict(F.col("verdict"), selected))


def p_wrong_or_prior(
    decisions: DataFrame, model_p: Column, base_rate: Column | float | None, priors: DataFrame
) -> DataFrame:
    """Model probability, else the calibrator's base rate, else the action's prior, else the default.

    ``priors`` holds one row per action.
    """
    rate = F.lit(base_rate).cast("double") if not isinstance(base_rate, Column) else base_rate
    dim = priors.select("action", F.col("prior").alias("_prior"))
    return (
        decisions.join(dim, "action", "left")
        .withColumn("p_wrong", F.coalesce(model_p, rate, F.col("_prior"), F.lit(SETTINGS.default_prior)))
        .drop("_prior")
    )


def replay_gate(
    decisions: DataFrame,
    keys: Sequence[str] = ("agent_id", "action", "band"),
    actions: DataFrame | None = None,
    signals: bool = False,
) -> DataFrame:
    """Decide every row with the budget its key had earned from earlier rows.

    The budget depends on earlier labels only, never on earlier verdicts, so the
    replay is a prefix sum over (ts, id) and needs no loop. ``signals`` adds the
    sensor invariants; otherwise only the hard limit is checked.
    """
    labelled = F.col("outcome").isin(*OUTCOMES)
    history = running_sums(
        price(decisions, actions),
        list(keys),
        ["ts_us", "id"],
        {
            "own_clean": F.when(F.col("outcome") == "clean", 1).otherwise(0).cast("bigint"),
            "own_total": F.when(labelled, 1).otherwise(0).cast("bigint"),
        },
    )
    p_lo = ledger.wilson_lower(F.col("own_clean"), F.col("own_total"))
    earned = ledger.budget(p_lo, F.col("ceiling"), F.col("own_total"))
    out = history.withColumn("p_lo", p_lo).withColumn("budget", F.coalesce(earned, F.lit(0.0)))
    if signals:
        out = with_invariants(out)
    else:
        out = out.withColumn("violated", F.coalesce(F.col("amount") > F.col("hard_limit"), F.lit(False)))
    return with_verdict(out)


def decide_batch(
    requests: DataFrame,
    trust: DataFrame,
    judgements: DataFrame,
    priors: DataFrame,
    model_p: Column | None = None,
    model_b: Column | None = None,
    actions: DataFrame | None = None,
    policies: DataFrame | None = None,
    calibrator_version: str = "bootstrap",
    capability_tier: str = "none",
    review_rate: float = SETTINGS.forced_review_rate,
) -> tuple[DataFrame, DataFrame]:
    """(decision rows, rejected requests): the whole path of one request, for a table of them.

    Requests carry id, ts_us, agent_id, action, amount, fingerprint, policy_mode
    and the sensor scores. ``model_p`` is the first probability, ``model_b`` the one
    after the deeper check (it may use ``judge_p``). The plan is narrow apart from the
    lookups of trust and judgement; the built-in configuration tables are broadcast.
    """
    if capability_tier not in CAPABILITY_TIERS:
        raise ValueError(f"unknown capability tier {capability_tier!r}")
    spark = requests.sparkSession
    modes = policies if policies is not None else F.broadcast(policy_table(spark))
    joined = pricing.with_action_terms(requests, actions).join(modes, "policy_mode", "left")
    idle = F.col("action").isin(*NON_EXECUTING_ACTIONS)
    reason = F.when(~idle & F.col("has_amount").isNull(), "unregistered_action").when(
        F.col("policy_k").isNull(), "unknown_policy_mode"
    )
    flagged = joined.withColumn("reject_reason", reason)
    rejected = flagged.filter("reject_reason is not null").select(*requests.columns, "reject_reason")

    label = pricing.band_label(F.col("amount"), F.col("action"), F.col("hard_limit"))
    banded = flagged.filter("reject_reason is null").drop("reject_reason").withColumn("band", label)
    funded = lookup_budget(price(banded), trust).withColumn(
        "budget", F.col("earned_budget") * F.col("budget_multiplier")
    )
    scored = p_wrong_or_prior(funded, model_p if model_p is not None else F.lit(None).cast("double"), None, priors)
    first = with_verdict(with_invariants(scored), F.col("policy_k"))
    final = with_rung(forced_review(resolve_tier2(first, judgements, model_b), review_rate))
    text = dec.decision_reason(
        F.col("verdict"), F.col("action"), F.col("band"), F.col("p_wrong"), F.col("exposure"), F.col("budget")
    )
    rows = final.withColumns(
        {
            "expected_loss": F.col("p_wrong") * F.col("exposure"),
            "horizon_us": F.col("ts_us") + F.coalesce(F.col("horizon_sec"), F.lit(0)) * 1_000_000,
            "calibrator_version": F.lit(calibrator_version),
            "capability_tier": F.lit(capability_tier),
            "degraded_mode": F.col("degraded_reason").isNotNull(),
            "reason": text,
        }
    )
    return rows, rejected

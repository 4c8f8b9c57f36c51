"""Trust per (agent, action, band, fingerprint): weighted record, breaker, budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import BAND_NAMES, OUTCOMES, SETTINGS, action_table
from trustlake.functions import ledger, pricing
from trustlake.operators.gate import TRUST_KEYS
from trustlake.operators.ranking import rolling_sum, running_sums


def _is(value: str) -> Column:
    return F.coalesce(F.col("outcome") == value, F.lit(False))


def weighted_counts(decisions: DataFrame, as_of_us: int, keys: Sequence[str] = TRUST_KEYS) -> DataFrame:
    """Evidence- and age-weighted clean and total counts, and the plain count of labelled rows."""
    weight = ledger.evidence_age_weight(F.col("source"), F.col("outcome_us"), F.col("ts_us"), as_of_us)
    labelled = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    return (
        decisions.withColumn("_w", F.when(labelled, weight).otherwise(0.0))
        .groupBy(*keys)
        .agg(
            F.sum(F.when(_is("clean"), F.col("_w")).otherwise(0.0)).alias("n_clean"),
            F.sum("_w").alias("n_total"),
            F.count(F.when(labelled, 1)).alias("n_own_raw"),
        )
    )


def recent_failures(decisions: DataFrame, keys: Sequence[str] = TRUST_KEYS) -> DataFrame:
    """Per row: wrong outcomes among the key's last 100 decisions, open ones counted as decisions."""
    wrong = _is("wrong").cast("bigint")
    rolled = rolling_sum(decisions, keys, ["ts_us", "id"], wrong, SETTINGS.trip_window, "failures")
    return rolled.withColumn("trips", F.col("failures") >= SETTINGS.trip_failures)


def record_tail(decisions: DataFrame, keys: Sequence[str] = TRUST_KEYS) -> DataFrame:
    """Per key: failures among the last 100 decisions and clean decisions since the last wrong one.

    Every row learns its position and how many wrong rows come before it. A row
    is in the tail when its position is one of the last 100, and after the last
    wrong one when all wrong rows of the key lie before it. So one prefix sum
    and one grouping answer both, however large a key is.
    """
    scanned = running_sums(
        decisions.select(*keys, "ts_us", "id", "outcome"),
        list(keys),
        ["ts_us", "id"],
        {"_pos": F.lit(1).cast("bigint"), "_wrong": _is("wrong").cast("bigint")},
        totals=True,
    )
    in_window = F.col("_pos") >= F.col("_pos_total") - SETTINGS.trip_window
    after_wrong = (F.col("_wrong") == F.col("_wrong_total")) & ~_is("wrong")
    return scanned.groupBy(*keys).agg(
        F.count(F.when(in_window & _is("wrong"), 1)).alias("failures"),
        F.count(F.when(after_wrong & _is("clean"), 1)).alias("clean_run"),
        F.count("*").alias("n_decisions"),
    )


def breaker_state(tail: DataFrame, as_of_us: int, prior: DataFrame | None = None, keys: Sequence[str] = TRUST_KEYS) -> DataFrame:
    """Add ``tripped_at`` and ``clean_since_trip``.

    Without prior state (or with an untripped one) three failures in the window
    trip the breaker; a tripped one clears after 50 clean decisions in a row.
    Note that a cleared breaker trips again on the next run while the failures
    are still inside the window.
    """
    if prior is None:
        state = tail.withColumn("_at", F.lit(None).cast("bigint")).withColumn("_run", F.lit(0).cast("bigint"))
    else:
        known = prior.select(*keys, F.col("tripped_at").alias("_at"), F.col("clean_since_trip").alias("_run"))
        state = tail.join(known, list(keys), "left")
    tripped = F.col("_at").isNotNull()
    trips = F.col("failures") >= SETTINGS.trip_failures
    clears = F.col("clean_run") >= SETTINGS.recover_clean
    at = (
        F.when(~tripped & trips, F.lit(as_of_us))
        .when(tripped & ~clears, F.col("_at"))
        .otherwise(F.lit(None).cast("bigint"))
    )
    run = (
        F.when(~tripped & trips, F.lit(0))
        .when(tripped & ~clears, F.col("clean_run"))
        .when(tripped, F.lit(0))
        .otherwise(F.coalesce("_run", F.lit(0)))
    )
    return (
        state.withColumn("tripped_at", at).withColumn("clean_since_trip", run.cast("bigint")).drop("_at", "_run")
    )


def borrow_strength(trust: DataFrame, keys: Sequence[str] = ("agent_id", "action", "fingerprint")) -> DataFrame:
    """Add ``k_eff`` and ``n_eff``: own counts plus decayed counts of the other bands of the key.

    Each row sends its share to all four bands and the shares are summed, so no
    rows are paired.
    """
    own = pricing.band_index(F.col("band"))
    bands = F.array(*[F.lit(b) for b in BAND_NAMES])
    sent = trust.withColumn("_own", own).select(
        *keys, "_own", "n_clean", "n_total", F.posexplode(bands).alias("_to", "_to_band")
    )
    distance = F.abs(F.col("_to") - F.col("_own"))
    share = F.when(distance == 0, F.lit(1.0)).otherwise(SETTINGS.borrow_weight * F.pow(F.lit(0.5), distance))
    pooled = sent.groupBy(*keys, F.col("_to_band").alias("band")).agg(
        F.sum(F.col("n_clean") * share).alias("k_eff"),
        F.sum(F.col("n_total") * share).alias("n_eff"),
    )
    return trust.join(pooled, [*keys, "band"])


def recompute_trust(
    decisions: DataFrame, as_of_us: int, prior: DataFrame | None = None, borrow: bool = False,
    actions: DataFrame | None = None,
) -> DataFrame:
    """Trust rows from the decision history as of ``as_of_us``.

    Unregistered and declining actions and the bands without a price mint no
    budget and are left out. A tripped breaker holds the budget at zero.
    """
    keys = list(TRUST_KEYS)
    priced = earning(decisions, actions)
    counts = weighted_counts(priced, as_of_us)
    if borrow:
        counts = borrow_strength(counts)
    else:
        counts = counts.withColumn("k_eff", F.col("n_clean")).withColumn("n_eff", F.col("n_total"))
    return trust_rows(counts.join(record_tail(priced), keys), as_of_us, prior, actions)


def trust_rows(record: DataFrame, as_of_us: int, prior: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Trust rows from each key's record: k_eff, n_eff, the counts, and the tail of ``record_tail``."""
    rows = pricing.with_action_terms(breaker_state(record, as_of_us, prior), actions)
    tripped = F.col("tripped_at").isNotNull()
    return (
        rows.withColumn("p_lo", ledger.wilson_lower(F.col("k_eff"), F.col("n_eff")))
        .withColumn("ceiling", pricing.ceiling(F.col("band")))
        .withColumn(
            "budget",
            F.when(tripped, F.lit(0.0)).otherwise(
                F.coalesce(ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("n_own_raw")), F.lit(0.0))
            ),
        )
        .withColumn("state", F.when(F.col("budget") > 0, "autonomous").otherwise("supervised"))
        .withColumn("updated_at", F.lit(as_of_us))
        .select(
            *TRUST_KEYS, "n_total", "n_clean", "n_own_raw", "p_lo", "budget", "ceiling", "state",
            "tripped_at", "clean_since_trip", "updated_at", "n_decisions",
        )
    )


def earning(decisions: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """The decisions that can earn a budget: registered actions in bands with a price."""
    dim = actions if actions is not None else F.broadcast(action_table(decisions.sparkSession))
    return decisions.filter(F.col("band").isin(*BAND_NAMES)).join(dim.select("action"), "action", "left_semi")


def upsert_trust(old: DataFrame, new: DataFrame, keys: Sequence[str] = TRUST_KEYS) -> DataFrame:
    """Next snapshot: new rows replace old ones with the same key, the others stay.

    Columns that only the old rows have keep their value.
    """
    keys = list(keys)
    incoming = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_hit"))
    merged = old.join(incoming, keys, "full")
    columns = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c)
        for c in old.columns
        if c not in keys
    ]
    return merged.select(*keys, *columns)


def trust_view(trust: DataFrame, agent_id: str | None = None, action: str | None = None) -> DataFrame:
    out = trust
    if agent_id is not None:
        out = out.filter(F.col("agent_id") == agent_id)
    if action is not None:
        out = out.filter(F.col("action") == action)
    return out


def trust_report(trust: DataFrame) -> DataFrame:
    """Trust rows in reading order."""
    return trust.select(
        "agent_id", "action", "band", "n_clean", "n_total", "n_own_raw", "p_lo", "budget", "ceiling", "state"
    ).orderBy("agent_id", "action", pricing.band_index(F.col("band")))

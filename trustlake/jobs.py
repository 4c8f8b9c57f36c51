"""The two scheduled jobs: the nightly run and the bootstrap of a labelled corpus.

    python -m trustlake.jobs --as-of EPOCH_SECONDS --decisions DIR --events DIR --trust DIR [--dry-run]

The reference time is always an argument; nothing here reads a clock.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.config import SETTINGS
from trustlake.functions import ledger, pricing
from trustlake.operators import calibration, drift, features, gate, models, outcomes, trust
from trustlake.session import build_session, durable, written
from trustlake.sources import model_store, tables


def nightly(
    decisions: DataFrame, events: DataFrame, as_of_us: int, old_trust: DataFrame | None = None, resume_breaker: bool = False
) -> dict[str, DataFrame]:
    """Close outcomes whose horizon has passed, recompute trust, and list the keys with enough rows for drift.

    ``resume_breaker`` continues from the stored breaker state; by default every
    run starts from an untripped breaker.
    """
    # both are read more than once below
    closed = durable(outcomes.resolve_outcomes(events, decisions, as_of_us))
    after = outcomes.apply_outcomes(decisions, closed)
    rows = durable(trust.recompute_trust(after, as_of_us, prior=old_trust if resume_breaker else None))
    checks = rows.select(
        *gate.TRUST_KEYS,
        F.col("n_decisions").alias("n_observations"),
        F.when(F.col("n_decisions") >= SETTINGS.drift_min_observations, "checked").otherwise("insufficient_data").alias("verdict"),
    )
    new = rows.drop("n_decisions")
    return {
        "closed": closed,
        "decisions": after,
        "events": outcomes.mark_processed(events, closed, as_of_us),
        "trust": new if old_trust is None else trust.upsert_trust(old_trust, new),
        "drift_checks": checks,
    }


def bootstrap(
    turns: DataFrame, tier: str = "none", agent_id: str = "agent_corpus", row_id: str = "id", embedding: str | None = None,
    version: str = "cal-v1", runtime_version: str = "", store: str | None = None,
) -> dict[str, DataFrame]:
    """Scored corpus, both calibrators, baselines, registry row and first trust rows from labelled turns with assembled ``features``.

    ``turns``: id, ts_us, action, amount, band, outcome, features. Every turn is
    scored by a calibrator fitted on earlier turns only and then replayed through
    the gate; the baselines come from a calibrator fitted on the first 80 % and
    measured on the frozen rest. With an ``embedding`` column the policy feature is filled out of fold first.
    Calibrator B stacks the out-of-fold probability and the judge's answer, on the judged rows of the first 80 %. With
    ``store`` both are published there under ``<version>-a`` and ``<version>-b`` before the registry row says that they are ready.
    """
    fields = turns.schema["features"].dataType.fieldNames()
    if embedding is not None:
        turns = with_policy_scores(turns, embedding, fields, row_id)
    names = features.model_features(tier, with_judge=False)
    vector = features.to_vector(F.col("features"), names, fields)
    # both are read many times, a few columns each time
    whole = written(turns.withColumn("vector", vector).withColumn("agent_id", F.lit(agent_id)))
    rows = calibration.temporal_split(whole, "ts_us", row_id)
    labelled = F.col("outcome").isin("clean", "wrong")
    wrong = F.col("outcome") == "wrong"
    train, test = F.col("split") == "train", F.col("split") == "test"

    model_a = models.fit_calibrator(rows.filter(labelled & train), "vector", wrong)
    frozen = model_a.transform(rows.filter(labelled & test), "vector")
    held_out = durable(
        calibration.reliability(
            calibration.reliability_bins(frozen.select(row_id, "p_wrong", "outcome"), [], "p_wrong", wrong, row_id), []
        )
    )
    scored = written(models.expanding_crossfit(rows, "vector", "ts_us", row_id).drop("vector"))
    judge = F.col("features")["judge_p_wrong"] if "judge_p_wrong" in fields else F.lit(None).cast("double")
    judged = scored.withColumn("judge_p", judge)
    model_b = models.fit_second(judged.filter(labelled & train), "p_wrong", "judge_p", wrong)
    second = models.crossfit_second(
        judged.select(row_id, "ts_us", "outcome", "split", "p_wrong", "judge_p"), "p_wrong", "judge_p", "ts_us", row_id
    )
    replayed = gate.replay_gate(
        scored.withColumns({s: F.col("features")[s] for s in ("pii_score", "injection_score", "secret_score")}),
        signals=True,
    )
    keys = ("agent_id", "action", "band")
    counts = scored.filter(labelled & pricing.band_max(F.col("band")).isNotNull()).groupBy(*keys).agg(
        F.count(F.when(wrong, None).otherwise(1)).alias("n_clean"), F.count("*").alias("n_total")
    )
    priced = pricing.with_action_terms(counts).filter(F.col("has_amount").isNotNull())
    first = (
        priced.withColumn("p_lo", ledger.wilson_lower(F.col("n_clean"), F.col("n_total")))
        .withColumn("ceiling", pricing.ceiling(F.col("band")))
        .withColumn("budget", F.coalesce(ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("n_total")), F.lit(0.0)))
        .withColumn("state", F.when(F.col("budget") > 0, "autonomous").otherwise("supervised"))
        .select(*keys, "n_clean", "n_total", "p_lo", "ceiling", "budget", "state")
    )
    null_rates = drift.null_rates(turns.select("features.*"), features.FEATURE_NAMES)
    spark = turns.sparkSession
    if store is not None:
        model_store.publish(spark, store, f"{version}-a", model_a, features.vector_names(names), runtime_version)
        model_store.publish(spark, store, f"{version}-b", model_b, models.STACKED, runtime_version)
    span = rows.agg(
        F.min("ts_us").alias("created_us"), F.max("ts_us").alias("ready_us"), F.min(F.when(test, F.col("ts_us"))).alias("boundary_us"),
        F.count(F.when(labelled & train, 1)).alias("n_train"), F.count(F.when(labelled & test, 1)).alias("n_test"),
    )
    held = held_out.first()
    ece, mce, brier = (F.lit(None if held is None else held[m]).cast("double") for m in ("ece", "mce", "brier"))
    baseline = span.select(
        F.lit(version).alias("version"), F.lit(tier).alias("capability_tier"), F.lit(runtime_version).alias("runtime_version"),
        F.array(*map(F.lit, names)).alias("model_a_features"), F.array(*map(F.lit, models.STACKED)).alias("model_b_features"),
        ece.alias("ece_global"), mce.alias("mce_global"), brier.alias("brier_global"), "boundary_us", "n_train", "n_test",
        F.lit(model_b.n).cast("bigint").alias("n_second"), F.lit(float(model_a.base_rate)).alias("fallback_prior"),
    )
    registry = span.select(
        F.lit(version).alias("version"), "created_us", F.col("ready_us").alias("promoted_us"), "ready_us", F.lit("production").alias("state"),
        F.lit("A").alias("promotion_path"), F.lit(runtime_version).alias("runtime_version"), F.lit(tier).alias("capability_tier"),
        ece.alias("ece_global"), F.col("n_train").alias("rows_carried"),
    )
    return {
        "scored": replayed.withColumn("p_wrong", F.round("p_wrong", 6)),
        "held_out": held_out,
        "second": second,
        "null_rates": null_rates,
        "base_rates": calibration.base_rates(rows),
        "baseline": baseline,
        "registry": registry,
        "trust": first,
    }


def with_policy_scores(turns: DataFrame, embedding: str, fields: list[str], row_id: str = "id") -> DataFrame:
    """``turns`` with the policy feature from heads fitted on earlier blocks; the embedding has done its work."""
    scored = models.crossfit_policy_head(turns, embedding, "ts_us", row_id)
    parts = []
    for name in fields:
        own = name in ("policy_score", "policy_score_unavailable")
        kind = turns.schema["features"].dataType[name].dataType
        parts.append((F.col(name).cast(kind) if own else F.col("features")[name]).alias(name))
    return scored.withColumn("features", F.struct(*parts)).drop("policy_score", "policy_score_unavailable", "block", embedding)


def close_call_delta(new_report: DataFrame, old_report: DataFrame) -> Column:
    """Change of the close-call error between two one-row criteria tables, as a constant for ``migrate_trust``."""
    values = [r.select("ece_close_call").head()[0] or 0.0 for r in (new_report, old_report)]
    return F.lit(values[0] - values[1])


def run_nightly(
    spark: SparkSession, decisions: DataFrame, events: DataFrame, root: str, as_of_us: int, dry_run: bool = False
) -> dict[str, DataFrame]:
    """One nightly run on the state under ``root``, and the next numbered state written there.

    The state is what the runs have decided, not a copy of the large tables: the log of
    closed outcomes (``closed``, one row a decision), to which a run appends what it closes, the
    trust rows, and the run's drift log. Segments of the log are merged now and then, so what a
    night writes follows what it closes. Earlier closings are laid over the decisions and mark their events
    as processed before anything is computed, so nothing closes twice and no later
    reference time picks another winner. The trust snapshot is written last; a run
    that broke off before has no number and is done again.
    """
    done = tables.snapshots(spark, root)
    old = tables.read_snapshot(spark, root)
    before = tables.read_segments(spark, f"{root}-closed", done[-1]) if done else None
    if before is not None:
        decisions = outcomes.apply_outcomes(decisions, before)
        marks = before.select("decision_id", F.col("closed_us").alias("_done"))
        events = (
            events.join(marks, "decision_id", "left")
            .withColumn("processed_us", F.coalesce("processed_us", "_done"))
            .select(*events.columns)
        )
    out = nightly(decisions, events, as_of_us, old)
    if not dry_run:
        number = done[-1] + 1 if done else 1
        closed = out["closed"].withColumn("closed_us", F.lit(as_of_us))
        tables.append_segment(closed, f"{root}-closed", number)
        tables.write_snapshot(out["drift_checks"].withColumn("run_us", F.lit(as_of_us)), f"{root}-drift", number)
        tables.write_snapshot(out["trust"], root, number)
        tables.compact_segments(spark, f"{root}-closed", number)
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trustlake.jobs")
    parser.add_argument("--as-of", type=float, required=True, help="reference time in epoch seconds")
    parser.add_argument("--decisions", required=True)
    parser.add_argument("--events", required=True)
    parser.add_argument("--trust", required=True, help="root folder of the state")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)

    spark = build_session("trustlake-nightly")
    inputs = spark.read.parquet(args.decisions), spark.read.parquet(args.events)
    out = run_nightly(spark, *inputs, args.trust, int(args.as_of * 1_000_000), args.dry_run)
    checked = out["drift_checks"].filter("verdict = 'checked'").count()
    print(f"closed {out['closed'].count()} outcomes, {out['trust'].count()} trust rows, {checked} keys with enough rows for drift")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Outcome reports and the closing of decisions at their horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.config import EVIDENCE_WEIGHTS, OUTCOMES
from trustlake.functions.ledger import source_weight


def accept_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): only registered sources and outcomes; the weight is stamped on arrival."""
    source = F.coalesce(F.col("source").isin(*EVIDENCE_WEIGHTS), F.lit(False))
    outcome = F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    reason = F.when(~source, "unregistered_source").when(~outcome, "unregistered_outcome")
    accepted = reports.filter(source & outcome).withColumn("weight", source_weight(F.col("source")))
    rejected = reports.filter(~(source & outcome)).withColumn("reject_reason", reason)
    return accepted, rejected


def due_decisions(decisions: DataFrame, as_of_us: int) -> DataFrame:
    """Open decisions whose horizon has passed."""
    return decisions.filter(F.col("outcome").isNull() & (F.col("horizon_us") <= as_of_us))


def open_events(events: DataFrame, decisions: DataFrame, as_of_us: int) -> DataFrame:
    """Unprocessed events of due decisions. Only the event side can be skewed; it is the streamed side."""
    due = due_decisions(decisions, as_of_us).select(F.col("id").alias("decision_id"))
    return events.filter(F.col("processed_us").isNull()).join(due, "decision_id", "left_semi")


def resolve_outcomes(events: DataFrame, decisions: DataFrame, as_of_us: int, strict: bool = False) -> DataFrame:
    """The closing outcome of every due decision that has an event.

    The heaviest event wins, then the newest, then the larger id. The winner is
    found per decision before the join, so a decision with very many events
    costs one row per map task. ``strict`` ignores events reported after ``as_of_us``.
    """
    pending = events.filter(F.col("processed_us").isNull())
    if strict:
        pending = pending.filter(F.col("reported_us") <= as_of_us)
    winner = F.max(F.struct("weight", "reported_us", "event_id", "outcome", "source")).alias("w")
    winners = pending.groupBy("decision_id").agg(winner)
    due = due_decisions(decisions, as_of_us).select(F.col("id").alias("decision_id"))
    return winners.join(due, "decision_id").select(
        "decision_id",
        F.col("w.outcome").alias("outcome"),
        F.col("w.source").alias("outcome_source"),
        F.col("w.reported_us").alias("outcome_us"),
    )


def apply_outcomes(decisions: DataFrame, closed: DataFrame) -> DataFrame:
    """Decisions with the resolved outcomes written in."""
    new = closed.select(
        F.col("decision_id").alias("id"),
        F.col("outcome").alias("_outcome"),
        F.col("outcome_source").alias("_source"),
        F.col("outcome_us").alias("_us"),
    )
    return (
        decisions.join(new, "id", "left")
        .withColumn("outcome", F.coalesce("outcome", "_outcome"))
        .withColumn("source", F.when(F.col("_outcome").isNotNull(), F.col("_source")).otherwise(F.col("source")))
        .withColumn("outcome_us", F.when(F.col("_outcome").isNotNull(), F.col("_us")).otherwise(F.col("outcome_us")))
        .select(*decisions.columns)
    )


def mark_processed(events: DataFrame, closed: DataFrame, as_of_us: int) -> DataFrame:
    """All open events of a closed decision are done, not only the winner."""
    done = closed.select("decision_id", F.lit(as_of_us).alias("_done"))
    return (
        events.join(done, "decision_id", "left")
        .withColumn("processed_us", F.coalesce("processed_us", "_done"))
        .drop("_done")
    )

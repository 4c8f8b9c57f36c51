"""Calibrator versions, promotion, migration of trust, and the fail-closed check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from trustlake.config import DAY_US, SETTINGS
from trustlake.functions import decision as dec
from trustlake.functions import ledger
from trustlake.operators.ranking import last_known


def newest_ready(registry: DataFrame, keys: Sequence[str] = ("capability_tier",)) -> DataFrame:
    """The production version that became ready last."""
    ready = registry.filter(F.col("ready_us").isNotNull() & (F.col("state") == "production"))
    return ready.groupBy(*keys).agg(
        F.max_by("version", "ready_us").alias("version"), F.max("ready_us").alias("ready_us")
    )


def calibrator_as_of(
    decisions: DataFrame, registry: DataFrame, tier: str = "capability_tier", ts: str = "ts_us", slices: int | None = None
) -> DataFrame:
    """Add ``as_of_version``: the newest version of the tier ready at the decision's time.

    Versions in production then and since retired both count. Versions and decisions are
    merged in the order of their times, and the last version is carried forward
    (``ranking.last_known``), so a registry of any length costs a row a version.
    """
    live = registry.filter(F.col("ready_us").isNotNull() & F.col("state").isin("production", "retired")).select(
        tier, F.col("ready_us").alias("_at"), F.lit(0).alias("_kind"), F.col("version").alias("_version"), F.lit(0).cast("bigint").alias("_tie")
    )
    plain = [f.name for f in decisions.schema if isinstance(f.dataType, AtomicType)]
    asked = decisions.withColumns(
        {
            "_at": F.col(ts),
            "_kind": F.lit(1),
            "_version": F.lit(None).cast(registry.schema["version"].dataType),
            "_tie": F.xxhash64(*plain),
        }
    )
    merged = asked.unionByName(live, allowMissingColumns=True)
    # a version that is ready at the very time counts; of several ready at one time the greatest does
    order = ["_at", "_kind", "_version", "_tie"]
    found = last_known(merged, [tier], order, F.col("_version"), "as_of_version", slices)
    return found.filter("_kind = 1").drop("_at", "_kind", "_version", "_tie")


def mixed_version_windows(decisions: DataFrame, window: str) -> DataFrame:
    """Windows in which more than one calibrator version decided."""
    return (
        decisions.groupBy(window)
        .agg(F.countDistinct("calibrator_version").alias("versions"), F.count("*").alias("n"))
        .filter("versions > 1")
    )


def exclude_mixed(decisions: DataFrame, window: str) -> DataFrame:
    return decisions.join(mixed_version_windows(decisions, window).select(window), window, "left_anti")


def promotion_path(registry: DataFrame, running_version: str) -> DataFrame:
    """Per candidate: blocked on a version mismatch, A when better on both errors with power, else B."""
    production = (
        registry.filter(F.col("state") == "production")
        .groupBy("capability_tier")
        .agg(F.max_by(F.struct("version", "ece_global", "ece_close_call"), F.col("ready_us")).alias("prod"))
    )
    power = (F.col("n_global") >= SETTINGS.min_region_n) & (F.col("n_close_call") >= SETTINGS.min_region_n)
    better = (F.col("ece_global") < F.col("prod.ece_global")) & (F.col("ece_close_call") < F.col("prod.ece_close_call"))
    return (
        registry.filter(F.col("state") == "candidate")
        .join(production, "capability_tier")
        .withColumn(
            "path",
            F.when(F.col("runtime_version") != running_version, "blocked")
            .when(F.coalesce(power & better, F.lit(False)), "A")
            .otherwise("B"),
        )
        .select("version", F.col("prod.version").alias("production"), "path")
    )


def shadow_ready(shadow: DataFrame, as_of_us: int, keys: Sequence[str] = ("version",)) -> DataFrame:
    """Is a shadowed challenger ready for a human decision: 30 days and 500 closed outcomes, and better.

    ``shadow`` has one row per shadowed decision: ts_us, outcome, p_wrong, challenger_p.
    """
    labelled = F.col("outcome").isin("clean", "wrong")
    y = (F.col("outcome") == "wrong").cast("int")

    def error(p: str) -> Column:
        return F.avg(F.when(labelled, (F.col(p) - y) * (F.col(p) - y)))

    return (
        shadow.groupBy(*keys)
        .agg(
            ((F.lit(as_of_us) - F.min("ts_us")) / F.lit(float(DAY_US))).alias("days"),
            F.count(F.when(labelled, 1)).alias("closed"),
            (error("challenger_p") < error("p_wrong")).alias("better"),
        )
        .withColumn(
            "ready",
            F.coalesce(F.col("better"), F.lit(False))
            & (F.col("days") >= SETTINGS.shadow_min_days)
            & (F.col("closed") >= SETTINGS.shadow_min_outcomes),
        )
    )


def migrate_trust(trust: DataFrame, delta: Column) -> DataFrame:
    """Carry, halve or reset trust by how far the new calibrator's close-call error moved.

    Halving touches the weighted counts only; a reset empties the row.
    """
    step = (
        F.when(delta <= SETTINGS.migrate_carry_max, "carry")
        .when(delta <= SETTINGS.migrate_halve_max, "halve")
        .otherwise("reset")
    )
    moved = trust.withColumn("migration", step)
    keep = F.when(F.col("migration") == "reset", 0.0).when(F.col("migration") == "halve", 0.5).otherwise(1.0)
    reset = F.col("migration") == "reset"
    return moved.withColumns(
        {
            "n_total": F.col("n_total") * keep,
            "n_clean": F.col("n_clean") * keep,
            "n_own_raw": F.when(reset, F.lit(0)).otherwise(F.col("n_own_raw")),
            "p_lo": F.when(reset, F.lit(0.0)).otherwise(F.col("p_lo")),
            "budget": F.when(reset, F.lit(0.0)).otherwise(F.col("budget")),
            "state": F.when(reset, F.lit("supervised")).otherwise(F.col("state")),
        }
    )


CURVE_POINTS = (4, 20, 30, 50, 73, 75, 100, 150, 200, 381, 400, 1000)  # fixed values: points of the curve


def earning_curve(records: DataFrame, points: Sequence[int] = CURVE_POINTS) -> DataFrame:
    """What each record would have earned at each length it has reached, were it all clean.

    ``records`` has ``n_clean`` (longest clean length) and ``ceiling`` per key.
    """
    reached = F.filter(F.array(*[F.lit(p).cast("bigint") for p in points]), lambda p: p <= F.col("n_clean"))
    out = records.withColumn("n", F.explode(reached))
    out = out.withColumn("p_lo", ledger.wilson_lower(F.col("n"), F.col("n")))
    return out.withColumn("budget", ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("n"))).withColumn(
        "share", F.col("budget") / F.col("ceiling")
    )


# fixed values: the parts that are knocked out, one at a time
KILLS = (
    "NONE", "TIER1_UNAVAILABLE", "TIER1_PARTIAL", "SOR_UNAVAILABLE", "LEDGER_ROW_MISSING",
    "TIER2_TIMEOUT", "TIER2_UNCONFIGURED", "FEATURES_UNAVAILABLE", "CALIBRATOR_STALE",
)


def fail_closed_check(decisions: DataFrame) -> DataFrame:
    """Acts per knocked-out part, compared with the healthy run: they must never rise.

    Rows need scores, amount, hard_limit, exposure, budget and p_wrong. Each row
    is decided once per kill and counted on the map side.
    """
    kill = F.col("kill")
    rows = decisions.withColumn("kill", F.explode(F.array(*[F.lit(k) for k in KILLS])))
    blind = kill == "TIER1_UNAVAILABLE"

    def score(name: str, extra: Column | None = None) -> Column:
        gone = blind | extra if extra is not None else blind
        return F.when(~gone, F.col(name))

    failed = dec.failed_invariants(
        score("pii_score"), score("injection_score", kill == "TIER1_PARTIAL"), score("secret_score"),
        F.col("amount"), F.col("hard_limit"),
    )
    p = F.when(kill.isin("SOR_UNAVAILABLE", "FEATURES_UNAVAILABLE"), F.lit(1.0)).otherwise(
        F.coalesce("p_wrong", F.lit(1.0))
    )
    budget = F.when(kill == "LEDGER_ROW_MISSING", F.lit(0.0)).otherwise(F.col("budget"))
    judged = F.when(kill.isin("TIER2_TIMEOUT", "TIER2_UNCONFIGURED"), p).otherwise(p * 0.3)
    violated = F.size(failed) > 0
    first = dec.decide(p, F.col("exposure"), budget, violated)
    second = dec.decide(judged, F.col("exposure"), budget, violated, 1.0)
    acts = (
        rows.withColumn("_v", F.when(first == "check_harder", second).otherwise(first))
        .groupBy("kill")
        .agg(F.count(F.when(F.col("_v") == "act", 1)).alias("acts"), F.count("*").alias("n"))
    )
    every_kill = Window.partitionBy(F.lit(0))  # one row per kill
    healthy = F.max(F.when(kill == "NONE", F.col("acts"))).over(every_kill)
    return acts.withColumn("healthy_acts", healthy).withColumn("holds", F.col("acts") <= F.col("healthy_acts"))

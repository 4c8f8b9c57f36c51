"""Reliability of probabilities, rank statistics, sampling bias and strict answer checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import JUDGE_VERDICTS, REGIONS, SETTINGS
from trustlake.functions.ledger import wilson
from trustlake.operators.ranking import before_cut, cut_points, equal_frequency_bin, global_rank, value_ranks

REGION_SCOPES = ("global", *REGIONS)


def quantile_bins(df: DataFrame, keys: Sequence[str], p: str, row_id: str, bins: int = SETTINGS.bins) -> DataFrame:
    """Add ``bin``: equal-frequency bins of ``p`` per key, ties ordered by ``row_id``."""
    ranked = global_rank(df, keys, [p, row_id, *keys], "_rank", totals=True)
    return ranked.withColumn("bin", equal_frequency_bin(F.col("_rank"), F.col("_rank_total"), bins)).drop(
        "_rank", "_rank_total"
    )


def reliability_bins(
    df: DataFrame, keys: Sequence[str], p: str, wrong: Column, row_id: str, bins: int = SETTINGS.bins
) -> DataFrame:
    """Per key and bin: rows, mean prediction, observed rate with its Wilson interval.

    ``sq`` carries the bin's sum of squared errors for the Brier score.
    """
    y = wrong.cast("int")
    binned = quantile_bins(df.select(*keys, p, row_id, y.alias("_y")), keys, p, row_id, bins)
    table = binned.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"),
        F.avg(p).alias("predicted"),
        F.sum("_y").alias("n_wrong"),
        F.sum((F.col(p) - F.col("_y")) * (F.col(p) - F.col("_y"))).alias("sq"),
    )
    low, high = wilson(F.col("n_wrong"), F.col("n"))
    return (
        table.withColumn("observed", F.col("n_wrong") / F.col("n")).withColumn("lo", low).withColumn("hi", high)
    )


def reliability(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ECE, MCE and Brier score per key from its (at most ten) bins."""
    gap = F.abs(F.col("observed") - F.col("predicted"))
    return (
        bins.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * gap).alias("_gap"),
            F.max(gap).alias("mce"),
            F.sum("sq").alias("_sq"),
        )
        .withColumn("ece", F.col("_gap") / F.col("n"))
        .withColumn("brier", F.col("_sq") / F.col("n"))
        .drop("_gap", "_sq")
    )


def by_scope(df: DataFrame, region: str) -> DataFrame:
    """Every row once for ``global`` and once for its region, in column ``scope``."""
    return df.withColumn("scope", F.explode(F.array(F.lit("global"), F.col(region))))


def reliability_by_region(df: DataFrame, p: str, wrong: Column, region: str, row_id: str) -> DataFrame:
    """Global and per-region reliability; bins are cut anew in every region.

    All four scopes are always present, with zeros where no row fell, and
    ``has_power`` says whether the region holds enough rows to judge.
    """
    scoped = by_scope(df.withColumn("_wrong", wrong), region)
    measured = reliability(reliability_bins(scoped, ["scope"], p, F.col("_wrong"), row_id), ["scope"])
    spark = df.sparkSession
    scopes = spark.createDataFrame([(s,) for s in REGION_SCOPES], "scope string")
    return (
        F.broadcast(scopes)
        .join(measured, "scope", "left")
        .select(
            "scope",
            F.coalesce("n", F.lit(0)).alias("n"),
            *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("ece", "mce", "brier")],
        )
        .withColumn("has_power", F.col("n") >= SETTINGS.min_region_n)
    )


def calibration_criteria(report: DataFrame) -> DataFrame:
    """One row: does the calibrator pass globally and in the close calls, with enough rows?"""
    def at(scope: str, column: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    one = report.agg(
        at("global", "ece").alias("ece_global"),
        at("close_call", "ece").alias("ece_close_call"),
        at("close_call", "n").alias("n_close_call"),
    )
    return one.withColumn(
        "passed",
        (F.col("ece_global") < SETTINGS.ece_global_max)
        & (F.col("ece_close_call") < SETTINGS.ece_close_call_max)
        & (F.col("n_close_call") >= SETTINGS.min_region_n),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value with the mean rank its holders share."""
    ranked = value_ranks(df, keys, value)
    return ranked.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key; 0 with fewer than two rows or without spread.

    Equal pairs are counted first. The mean of average ranks is always (n+1)/2,
    so the sums are centred without a second pass.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_w"))
    def ranks(column: str, name: str) -> DataFrame:
        ranked = value_ranks(pairs, keys, column, F.col("_w"))
        centred = F.col("before") + (F.col("n") - F.col("n_total")) / 2
        return ranked.select(*keys, column, centred.alias(name))

    joined = pairs.join(ranks(x, "_dx"), [*keys, x]).join(ranks(y, "_dy"), [*keys, y])
    sums = joined.groupBy(*keys).agg(
        F.sum("_w").alias("n"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")).alias("_xy"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dx")).alias("_xx"),
        F.sum(F.col("_w") * F.col("_dy") * F.col("_dy")).alias("_yy"),
    )
    flat = (F.col("n") < 2) | (F.col("_xx") == 0) | (F.col("_yy") == 0)
    rho = F.when(flat, F.lit(0.0)).otherwise(F.col("_xy") / (F.sqrt("_xx") * F.sqrt("_yy")))
    return sums.select(*keys, "n", F.coalesce(rho, F.lit(0.0)).alias("rho"))


def decile(value: Column) -> Column:
    return F.least(F.lit(9), F.floor(value * 10))


def distinct_deciles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(decile(F.col(value))).alias("deciles"))


def ipw_rate(df: DataFrame, keys: Sequence[str], wrong: Column, rate: Column | float) -> DataFrame:
    """Error rate weighted by the inverse sampling rate; 0 without rows.

    A constant rate outside (0, 1] is an error; rows with such a rate get no weight.
    """
    if isinstance(rate, (int, float)):
        if not 0.0 < rate <= 1.0:
            raise ValueError(f"sampling rate must be in (0, 1], got {rate}")
        rate = F.lit(float(rate))
    w = F.when((rate > 0) & (rate <= 1), 1 / rate)
    return (
        df.groupBy(*keys)
        .agg(F.sum(w).alias("_w"), F.sum(w * wrong.cast("int")).alias("_wy"), F.count(w).alias("n"))
        .select(*keys, "n", F.coalesce(F.try_divide("_wy", "_w"), F.lit(0.0)).alias("ipw_rate"))
    )


def sampling_bias(df: DataFrame, keys: Sequence[str], wrong: Column, forced: Column, rate: float) -> DataFrame:
    """Error rate over all labelled rows, over the forced reviews only, and their difference."""
    if not 0.0 < rate <= 1.0:
        raise ValueError(f"sampling rate must be in (0, 1], got {rate}")
    y = wrong.cast("int")
    return (
        df.groupBy(*keys)
        .agg(
            F.coalesce(F.avg(y), F.lit(0.0)).alias("naive_rate"),
            F.coalesce(
                F.try_divide(F.sum(F.when(forced, y / F.lit(rate))), F.sum(F.when(forced, 1 / F.lit(rate)))), F.lit(0.0)
            ).alias("ipw_rate"),
            F.count(F.when(forced, 1)).alias("n_forced"),
        )
        .withColumn("bias", F.col("naive_rate") - F.col("ipw_rate"))
    )


def temporal_split(df: DataFrame, ts_us: str, row_id: str, test_fraction: float = SETTINGS.test_fraction) -> DataFrame:
    """Add ``split``: the first rows in time train, the last share is the frozen test set."""
    cut = cut_points(df, [ts_us, row_id], [F.floor(F.col("n_total") * F.lit(1.0 - test_fraction))])[0]
    return df.withColumn("split", F.when(before_cut(df, cut), "train").otherwise("test"))


def halves(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``half``: 0 for the first ``n div 2`` rows in ``order``, 1 for the rest."""
    cut = cut_points(df, list(order), [F.floor(F.col("n_total") / 2)])[0]
    return df.withColumn("half", F.when(before_cut(df, cut), 0).otherwise(1))


# --- strict checks of JSON answers ------------------------------------------------

JUDGE_SHAPE = r"^OBJECT<p_wrong: (BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)), reasons: ARRAY<(STRING|VOID)>, verdict: STRING>$"


def validate_judgements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``judge_p``, ``judge_verdict``, ``reasons`` and ``degraded_reason``.

    Exactly the three keys, a number (no string, no boolean) in [0, 1], a known
    verdict and a list of strings; anything else is unavailable, never a default.
    """
    parsed = F.try_parse_json(F.col(raw))
    shape = F.schema_of_variant(F.col("_v")).rlike(JUDGE_SHAPE)
    p = F.try_variant_get(F.col("_v"), "$.p_wrong", "double")
    verdict = F.try_variant_get(F.col("_v"), "$.verdict", "string")
    reasons = F.try_variant_get(F.col("_v"), "$.reasons", "array<string>")
    good = F.coalesce(
        F.col("_shape")
        & F.col("_p").between(0, 1)
        & F.col("_verdict").isin(*JUDGE_VERDICTS)
        & ~F.exists("_reasons", lambda r: r.isNull()),
        F.lit(False),
    )
    return (
        df.withColumn("_v", parsed)
        .withColumns({"_shape": shape, "_p": p, "_verdict": verdict, "_reasons": reasons})
        .withColumn("_ok", good)
        .withColumns(
            {
                "judge_p": F.when(F.col("_ok"), F.col("_p")),
                "judge_verdict": F.when(F.col("_ok"), F.col("_verdict")),
                "reasons": F.when(F.col("_ok"), F.col("_reasons")),
                "degraded_reason": F.when(~F.col("_ok"), F.lit("TIER2_SCHEMA_VIOLATION")),
            }
        )
        .drop("_v", "_shape", "_p", "_verdict", "_reasons", "_ok")
    )


AGENT_ACTIONS = ("issue_refund", "escalate", "no_action")  # fixed values: the agent's action types


def validate_agent_output(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``reply_text``, ``claims``, ``action`` and ``valid`` for raw agent answers.

    The reply is not empty, the four claims have their types, amounts are not
    negative and the action is known. Numbers in strings are read as numbers;
    unknown extra keys are ignored.
    """
    v = F.col("_v")

    def text(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(v, path, "string"))

    def whole(path: str) -> Column:
        number = F.try_variant_get(v, path, "double")
        return F.when(number == F.floor(number), F.try_variant_get(v, path, "bigint"))

    def flag(path: str) -> Column:
        return F.try_variant_get(v, path, "boolean")

    parts = {
        "reply_text": text("$.reply_text"),
        "claims": F.struct(
            text("$.claims.order_id").alias("order_id"),
            flag("$.claims.duplicate_charge").alias("duplicate_charge"),
            whole("$.claims.refund_amount_paise").alias("refund_amount_paise"),
            flag("$.claims.already_refunded").alias("already_refunded"),
        ),
        "action": F.struct(
            text("$.action.type").alias("type"),
            whole("$.action.amount_paise").alias("amount_paise"),
            text("$.action.order_id").alias("order_id"),
        ),
    }
    claim, act = F.col("claims"), F.col("action")
    valid = (
        (F.length("reply_text") > 0)
        & claim["order_id"].isNotNull()
        & claim["duplicate_charge"].isNotNull()
        & (claim["refund_amount_paise"] >= 0)
        & claim["already_refunded"].isNotNull()
        & act["type"].isin(*AGENT_ACTIONS)
        & (act["amount_paise"] >= 0)
        & act["order_id"].isNotNull()
    )
    return (
        df.withColumn("_v", F.try_parse_json(F.col(raw)))
        .withColumns(parts)
        .drop("_v")
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
    )


def schema_violation_rate(checked: DataFrame, bad: Column, limit: float = 0.02) -> DataFrame:
    """Attempts, violations and whether their rate stays within the limit."""
    return (
        checked.agg(F.count("*").alias("attempts"), F.count(F.when(bad, 1)).alias("violations"))
        .withColumn("rate", F.coalesce(F.try_divide("violations", "attempts"), F.lit(0.0)))
        .withColumn("within_limit", F.col("rate") <= limit)
    )


def base_rates(df: DataFrame) -> DataFrame:
    """Wrong rate over all labelled rows (action NULL) and per action."""
    labelled = df.filter(F.col("outcome").isin("clean", "wrong"))
    wrong = F.avg((F.col("outcome") == "wrong").cast("int"))
    return labelled.rollup("action").agg(F.count("*").alias("n"), wrong.alias("base_rate"))



"""Checks a labelled corpus must pass before anything is fitted on it.

Every check is a one-row table (check, status, detail) with status PASS, FAIL or
SKIP, so the gate is their union and stays lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import BAND_NAMES, FEATURE_NAMES, SETTINGS
from trustlake.functions.pricing import band_of


def _row(df: DataFrame, check: str, skip: Column, ok: Column, detail: Column) -> DataFrame:
    status = F.when(F.coalesce(skip, F.lit(True)), "SKIP").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return df.select(F.lit(check).alias("check"), status.alias("status"), detail.alias("detail"))


def stored_order(rows: DataFrame, features: str = "features") -> DataFrame:
    """Position and name of the features as a stored table has them, without their flags and what says how they were made."""
    fields = [f for f in rows.schema[features].dataType.fieldNames() if f not in ("as_of", "capability_tier")]
    names = list(enumerate(f for f in fields if not f.endswith("_unavailable")))
    return rows.sparkSession.createDataFrame(names, "position int, name string")


def feature_order(fields: DataFrame) -> DataFrame:
    """``fields``: position and name of the stored feature order."""
    order = fields.agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("_f"))
    names = F.transform("_f", lambda f: f["name"])
    want = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    return _row(
        order, "feature-order", F.size("_f") == 0, names == want,
        F.concat(F.size("_f").cast("string"), F.lit(" features")),
    )


def null_semantics(rates: DataFrame) -> DataFrame:
    """``rates``: flag, rate and inside, as ``drift.unavailable_rates`` gives them (one row per feature)."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("inside"), F.col("flag"))))
    one = rates.agg(bad.alias("_bad"), F.count("rate").alias("_n"))
    detail = F.when(F.size("_bad") == 0, "every feature inside its envelope").otherwise(
        F.concat(F.lit("outside: "), F.array_join("_bad", ", "))
    )
    return _row(one, "null-semantics", F.col("_n") == 0, F.size("_bad") == 0, detail)


def label_balance(turns: DataFrame) -> DataFrame:
    one = turns.agg(
        F.count(F.when(F.col("outcome") == "wrong", 1)).alias("_wrong"),
        F.count(F.when(F.col("outcome").isin("clean", "wrong"), 1)).alias("_n"),
    ).withColumn("_rate", F.try_divide("_wrong", "_n"))
    ok = F.col("_rate").between(SETTINGS.label_rate_min, SETTINGS.label_rate_max)
    detail = F.concat(F.col("_wrong").cast("string"), F.lit(" wrong of "), F.col("_n").cast("string"))
    return _row(one, "label-balance", F.col("_n") == 0, ok, detail)


def band_coverage(turns: DataFrame, amount: str, limit: float) -> DataFrame:
    band = F.when(F.col(amount) <= limit, band_of(F.col(amount)))
    one = turns.agg(
        F.count(amount).alias("_n"), *[F.count(F.when(band == b, 1)).alias(f"_{i}") for i, b in enumerate(BAND_NAMES)]
    )
    counts = [F.col(f"_{i}") for i in range(len(BAND_NAMES))]
    ok = reduce(lambda a, b: a & b, [c >= SETTINGS.band_min_rows for c in counts])
    text = [F.concat(F.lit(f"{b}="), c.cast("string")) for b, c in zip(BAND_NAMES, counts)]
    return _row(one, "band-coverage", F.col("_n") == 0, ok, F.concat_ws(", ", *text))


def region_coverage(turns: DataFrame) -> DataFrame:
    one = turns.agg(
        F.count("region").alias("_n"), F.count(F.when(F.col("region") == "close_call", 1)).alias("_close")
    )
    ok = F.col("_close") >= SETTINGS.min_region_n
    return _row(
        one, "region-coverage", F.col("_n") == 0, ok, F.concat(F.col("_close").cast("string"), F.lit(" close_call turns"))
    )


def distribution_stability(measured: DataFrame, rows: DataFrame) -> DataFrame:
    """``measured``: feature, psi and breach (one row per feature); ``rows``: the corpus itself."""
    size = rows.agg(F.count("*").alias("_n"))
    breaches = measured.agg(F.array_sort(F.collect_list(F.when(F.col("breach"), F.col("feature")))).alias("_bad"))
    one = size.unionByName(breaches, allowMissingColumns=True).agg(
        F.max("_n").alias("_n"), F.max("_bad").alias("_bad")
    )
    detail = F.when(F.size("_bad") == 0, "all features stable across the halves").otherwise(
        F.concat(F.lit("moved: "), F.array_join("_bad", ", "))
    )
    return _row(one, "distribution-stability", F.col("_n") < SETTINGS.stability_min_rows, F.size("_bad") == 0, detail)


def judge_calibration(correlation: DataFrame, deciles: DataFrame) -> DataFrame:
    """``correlation``: n and rho; ``deciles``: deciles. One row each."""
    one = correlation.select("n", "rho").unionByName(deciles.select("deciles"), allowMissingColumns=True).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("_n"), F.max("rho").alias("_rho"), F.max("deciles").alias("_d")
    )
    ok = (F.col("_rho") >= SETTINGS.judge_min_rho) & (F.col("_d") >= SETTINGS.judge_min_deciles)
    detail = F.concat(
        F.lit("rho="), F.format_string("%.3f", "_rho"), F.lit(" over "), F.col("_n").cast("string"),
        F.lit(" rows, spans "), F.col("_d").cast("string"), F.lit(" deciles"),
    )
    return _row(one, "judge-calibration", F.col("_n") < SETTINGS.judge_min_pairs, ok, detail)


def judge_schema(answers: DataFrame, order: str, bad: Column) -> DataFrame:
    """The first 50 answers may hold one violation."""
    sample = answers.select(F.col(order).alias("_o"), bad.alias("_bad")).orderBy("_o").limit(SETTINGS.judge_sample)
    one = sample.agg(F.count("*").alias("_n"), F.count(F.when(F.col("_bad"), 1)).alias("_v"))
    detail = F.concat(
        F.col("_v").cast("string"), F.lit(" violation(s) in "), F.col("_n").cast("string"), F.lit(" calls")
    )
    return _row(one, "judge-schema", F.col("_n") == 0, F.col("_v") <= SETTINGS.judge_max_violations, detail)


def judge_mode(judgements: DataFrame) -> DataFrame:
    one = judgements.agg(F.countDistinct(F.struct("model", "thinking")).alias("_modes"))
    detail = F.concat(F.col("_modes").cast("string"), F.lit(" judge configuration(s)"))
    return _row(one, "judge-mode", F.col("_modes") == 0, F.col("_modes") == 1, detail)


def validation_gate(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks as one table; fitting is allowed when no row says FAIL."""
    return reduce(DataFrame.unionByName, checks)


def blocks_fitting(gate: DataFrame) -> DataFrame:
    return gate.agg(F.count(F.when(F.col("status") == "FAIL", 1)).alias("failed")).withColumn(
        "blocked", F.col("failed") > 0
    )

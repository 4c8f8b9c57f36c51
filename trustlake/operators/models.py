"""Fitting calibrators with pyspark.ml, and the Platt scaler per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import SETTINGS
from trustlake.operators.ranking import before_cut, cut_points
from trustlake.session import durable, written


@dataclass
class Calibrator:
    """A fitted model, or the base rate where the labels had one class only."""

    model: Any | None
    base_rate: float
    n: int

    def transform(self, df: DataFrame, vector: str, out: str = "p_wrong") -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.base_rate))
        scored = self.model.transform(df.withColumn("_features", as_vector(df, vector)))
        return scored.withColumn(out, vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_class")


def as_vector(df: DataFrame, vector: str) -> Column:
    """A column of arrays or of vectors as vectors."""
    return array_to_vector(F.col(vector)) if df.schema[vector].dataType.typeName() == "array" else F.col(vector)


def fit_calibrator(df: DataFrame, vector: str, wrong: Column, c: float = 1.0) -> Calibrator:
    """L2 logistic regression on an array or vector column, without class weights.

    The penalty is 1/(C n) of the mean loss, the same objective as a penalty of
    1/C on the summed loss; the intercept is not penalised and inputs are not scaled.
    """
    data = df.select(as_vector(df, vector).alias("_features"), wrong.cast("double").alias("_y"))
    n, positive = data.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    if n == 0:
        return Calibrator(None, SETTINGS.default_prior, 0)
    if positive in (0.0, float(n)):
        return Calibrator(None, positive / n, n)
    learner = LogisticRegression(
        featuresCol="_features", labelCol="_y", predictionCol="_class", probabilityCol="_probability",
        rawPredictionCol="_raw", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=500, tol=1e-10,
    )
    return Calibrator(learner.fit(data), positive / n, n)


def score_column(calibrator: Calibrator, inputs: Sequence[Column]) -> Column:
    """The calibrator's probability as one expression over its inputs, for plans that take a column."""
    if calibrator.model is None:
        return F.lit(float(calibrator.base_rate))
    margin = F.lit(float(calibrator.model.intercept))
    for weight, value in zip(calibrator.model.coefficients, inputs, strict=True):
        margin = margin + F.lit(float(weight)) * value
    return 1 / (1 + F.exp(-margin))


def logit(p: Column) -> Column:
    """Log odds of a probability kept away from 0 and 1."""
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(clipped / (1 - clipped))


#: Inputs of the second calibrator, in order.
STACKED = ("p_logit", "judge_logit", "gap")


def stacked_inputs(p: Column, judge: Column) -> dict[str, Column]:
    """What the second calibrator sees: the first probability, the judge's answer, and how far they are apart."""
    return dict(zip(STACKED, (logit(p), logit(judge), F.abs(logit(p) - logit(judge)))))


def fit_second(df: DataFrame, p: str, judge: str, wrong: Column, c: float = 1.0) -> Calibrator:
    """Calibrator B: stacks the first probability and the judge's answer, on the labelled rows that were judged.

    ``p`` has to come out of fold (``expanding_crossfit``): a first probability that has seen the row's label would be
    trusted more than the one that the gate has.
    """
    judged = df.filter(F.col(p).isNotNull() & F.col(judge).isNotNull())
    vector = F.array(*stacked_inputs(F.col(p), F.col(judge)).values())
    return fit_calibrator(judged.withColumn("_stacked", vector), "_stacked", wrong, c)


def second_column(calibrator: Calibrator, p: Column, judge: Column) -> Column:
    """B's probability for ``decide_batch(model_b=..)``; null where the judge gave no answer."""
    return F.when(judge.isNotNull(), score_column(calibrator, list(stacked_inputs(p, judge).values())))


def crossfit_second(
    df: DataFrame, p: str, judge: str, ts_us: str, row_id: str, out: str = "p_second", blocks: int = SETTINGS.crossfit_blocks
) -> DataFrame:
    """Add ``out``: B's probability of each judged row from earlier blocks only, null in the first block and without an answer."""
    wrong = F.col("outcome") == "wrong"
    rows = written(time_blocks(df, ts_us, row_id, blocks))
    column = F.lit(None).cast("double")
    for b in range(1, blocks):
        past = rows.filter(F.col("outcome").isin("clean", "wrong") & (F.col("block") < b))
        fitted = fit_second(past, p, judge, wrong)
        if fitted.n:
            column = F.when(F.col("block") == b, second_column(fitted, F.col(p), F.col(judge))).otherwise(column)
    return rows.withColumn(out, column)


def time_blocks(df: DataFrame, ts_us: str, row_id: str, blocks: int = SETTINGS.crossfit_blocks) -> DataFrame:
    """Add ``block``: equal runs of rows in time order, the last one takes the remainder."""
    size = F.greatest(F.lit(1), F.floor(F.col("n_total") / blocks))
    cuts = cut_points(df, [ts_us, row_id], [size * b for b in range(1, blocks)])
    block = F.lit(0)
    for cut in cuts:
        block = block + (~before_cut(df, cut)).cast("int")
    return df.withColumn("block", block)


def expanding_crossfit(
    df: DataFrame, vector: str, ts_us: str, row_id: str, out: str = "p_wrong", blocks: int = SETTINGS.crossfit_blocks,
) -> DataFrame:
    """Score every block with a model fitted on earlier blocks only; the first gets the base rate.

    The driver runs one fit per block; rows never leave the executors.
    """
    rows = written(time_blocks(df, ts_us, row_id, blocks))
    wrong = F.col("outcome") == "wrong"
    base = rows.filter(F.col("outcome").isin("clean", "wrong")).agg(F.avg(wrong.cast("int"))).first()[0]
    rate = F.lit(base if base is not None else SETTINGS.default_prior)
    parts = [rows.filter("block = 0").withColumn(out, rate)]
    for b, fitted in enumerate(block_models(rows, vector, blocks), 1):
        here = rows.filter(F.col("block") == b)
        parts.append(here.withColumn(out, rate) if fitted.n == 0 else fitted.transform(here, vector, out))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def block_models(rows: DataFrame, vector: str, blocks: int = SETTINGS.crossfit_blocks) -> list[Calibrator]:
    """The models of the blocks 1, 2, ..: each fitted on the labelled rows of the blocks before it."""
    labelled, wrong = F.col("outcome").isin("clean", "wrong"), F.col("outcome") == "wrong"
    return [fit_calibrator(rows.filter(labelled & (F.col("block") < b)), vector, wrong) for b in range(1, blocks)]


def fit_policy_head(df: DataFrame, embedding: str, wrong: Column) -> Calibrator:
    """Logistic head on sentence embeddings."""
    vector = df.withColumn("_embedding", F.transform(embedding, lambda v: v.cast("double")))
    return fit_calibrator(vector, "_embedding", wrong)


def crossfit_policy_head(
    df: DataFrame, embedding: str, ts_us: str, row_id: str, out: str = "policy_score", blocks: int = SETTINGS.crossfit_blocks
) -> DataFrame:
    """Add ``out`` and ``<out>_unavailable``: every block scored by a head that saw earlier blocks only.

    A head that scored its own training rows would hand the calibrator labels in
    disguise. The first block, blocks whose past has one class only, and rows without
    an embedding have no score.
    """
    wrong = F.col("outcome") == "wrong"
    vector = F.transform(embedding, lambda v: v.cast("double"))
    rows = durable(time_blocks(df, ts_us, row_id, blocks).withColumn("_embedding", vector))
    usable = F.col("_embedding").isNotNull()
    parts = [rows.filter(~usable | (F.col("block") == 0)).withColumn(out, F.lit(None).cast("double"))]
    for b in range(1, blocks):
        past = rows.filter(usable & F.col("outcome").isin("clean", "wrong") & (F.col("block") < b))
        fitted = fit_calibrator(past, "_embedding", wrong)
        here = rows.filter(usable & (F.col("block") == b))
        scored = here.withColumn(out, F.lit(None).cast("double")) if fitted.model is None else fitted.transform(here, "_embedding", out)
        parts.append(scored.select(parts[0].columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn(f"{out}_unavailable", F.col(out).isNull().cast("int")).drop("_embedding")


@dataclass
class TextClassifier:
    """Hashed word counts and a logistic head, fitted on labelled texts; scores whole texts in the JVM."""

    calibrator: Calibrator
    buckets: int

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add ``out`` and ``<out>_unavailable``; a text without words has no score."""
        found = self.calibrator.transform(word_counts(df, text, self.buckets), "_counts", out)
        has_words = F.size("_words") > 0
        return found.withColumns(
            {out: F.when(has_words, F.col(out)), f"{out}_unavailable": (~has_words).cast("int")}
        ).drop("_words", "_counts")


def word_counts(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """Add ``_words`` and ``_counts``: the share of a text's words in each hash bucket, as a vector."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    hashing = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets)
    return Normalizer(inputCol="_raw_counts", outputCol="_counts", p=1.0).transform(
        hashing.setOutputCol("_raw_counts").transform(df.withColumn("_words", words))
    ).drop("_raw_counts")


def fit_text_classifier(df: DataFrame, text: str, wrong: Column, buckets: int = 4096, c: float = 1000.0) -> TextClassifier:
    """Logistic regression on hashed word shares of whole texts."""
    return TextClassifier(fit_calibrator(word_counts(df, text, buckets), "_counts", wrong, c), buckets)


def platt_steps(iterations: int, rate: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Gradient descent on (a, b) over weighted (p, n, n_wrong) rows of one key."""

    def fit(rows: pd.DataFrame) -> tuple[float, float]:
        import numpy as np

        p = np.clip(rows["p"].to_numpy(float), 1e-6, 1 - 1e-6)
        x, n, wrong = np.log(p / (1 - p)), rows["n"].to_numpy(float), rows["n_wrong"].to_numpy(float)
        total = n.sum()
        a, b = 1.0, 0.0
        for _ in range(iterations):
            error = n / (1 + np.exp(-(a * x + b))) - wrong
            a -= rate * float((error * x).sum()) / total
            b -= rate * float(error.sum()) / total
        return a, b

    return fit


def fit_platt(
    df: DataFrame, keys: Sequence[str], p: str, wrong: Column, iterations: int = 200, rate: float = 0.1
) -> DataFrame:
    """Platt parameters (a, b) per key by a fixed number of gradient steps from (1, 0).

    Scores are kept at six decimals, so a key folds to at most 1,000,001 weighted
    rows before it reaches its task. Keys without rows have no parameters.
    """
    keys = list(keys)
    folded = (
        df.groupBy(*keys, F.round(p, 6).alias("p"))
        .agg(F.count("*").alias("n"), F.sum(wrong.cast("int")).alias("n_wrong"))
        .withColumn("_all", F.lit(1))
    )
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in folded.schema.fields if f.name in keys]
        + ["a double", "b double", "n bigint"]
    )
    steps = platt_steps(iterations, rate)

    def per_key(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = steps(rows)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "a": a, "b": b, "n": int(rows["n"].sum())}])

    return folded.groupBy(*(keys or ["_all"])).applyInPandas(per_key, schema)

"""Jobs over texts: span scans, retrieval support, conversation turns, model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.functions import text as tx

Scorer = Callable[[list[str]], list[float | None]]


def scan(df: DataFrame, text: str, spans: bool = False) -> DataFrame:
    """Add ``secret_score`` and ``pii_score`` (and the span list) for a text column; no shuffle."""
    out = df.withColumn("secret_score", tx.secret_score(F.col(text))).withColumn("pii_score", tx.pii_score(F.col(text)))
    return out.withColumn("spans", tx.spans(F.col(text))) if spans else out


def retrieval_support(df: DataFrame, text: str, chunks: str, no_chunks_zero: bool = False) -> DataFrame:
    """Add ``retrieval_support_min`` and ``_mean``.

    Without retrieved chunks the pair is NULL (not measured); ``no_chunks_zero``
    makes it a measured 0.0 instead.
    """
    scores = tx.sentence_support(F.col(text), F.col(chunks))
    scored = df.withColumn("_scores", scores)
    low = tx.support_min(F.col("_scores"), F.col(chunks))
    mean = tx.support_mean(F.col("_scores"), F.col(chunks))
    missing = F.col(chunks).isNull() | (F.size(chunks) == 0)
    empty = F.lit(0.0) if no_chunks_zero else F.lit(None).cast("double")
    return (
        scored.withColumn("retrieval_support_min", F.when(missing, empty).otherwise(low))
        .withColumn("retrieval_support_mean", F.when(missing, empty).otherwise(mean))
        .drop("_scores")
    )


def last_user_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation the text of the last user turn, or an empty string.

    ``max_by`` keeps one turn per conversation and map task, so a very long
    conversation does not travel.
    """
    is_user = F.col("role") == "user"
    newest = F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col(turn)))
    return turns.groupBy(conv).agg(F.coalesce(newest, F.lit("")).alias("user_text"))


def tool_counts(df: DataFrame, calls: str) -> DataFrame:
    return df.withColumn("tool_retry_count", tx.tool_retries(F.col(calls))).withColumn(
        "tool_error_count", tx.tool_errors(F.col(calls))
    )


def score_text_model(df: DataFrame, text: str, factory: Callable[[], Scorer] | None, name: str) -> DataFrame:
    """Add a model score of the whole text and ``<name>_unavailable``.

    ``factory`` opens the model once per Python worker task and returns a function from
    a batch of texts to scores. Without a model the score is NULL and flagged.
    """
    if factory is None:
        return df.withColumn(name, F.lit(None).cast("double")).withColumn(f"{name}_unavailable", F.lit(1))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), dtype="float64")

    return df.withColumn(name, score(F.col(text))).withColumn(
        f"{name}_unavailable", F.col(name).isNull().cast("int")
    )


def linear_head(embedding: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Logistic head on an embedding, without leaving the JVM."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(
        F.zip_with(embedding, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda acc, v: acc + v
    )
    return 1 / (1 + F.exp(-dot))


def merge_pii(regex: Column, model: Column, model_available: Column) -> Column:
    """Larger of shape hit and entity score; without the model only a hit counts."""
    return F.when(model_available, F.greatest(F.coalesce(regex, F.lit(0.0)), model)).otherwise(regex)

"""The queries of this subpackage: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import (
    alignment,
    bpe,
    counting,
    html,
    importance,
    mixing,
    packing,
    ppm,
    quality,
    simhash,
    substrings,
    topk,
    toxicity,
)
from trustlake.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    """Path of the rank file and the pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = tokenizer_files()
    ranks = bpe.read_ranks(path)
    return bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, radius=3, blocks=5).select(
        "doc_id", simhash.hex16("fingerprint").alias("fingerprint"), F.col("component").alias("component_id")
    )


@query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op6_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    measures = quality.measured(table(spark, sf, "documents").select("doc_id", "text", "source")).drop("text")
    return quality.judged(stored(measures, "measures")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"
    )


@query
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op1_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", topk.integers("embedding").alias("vector"))
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op1_top_k"] = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
scored as (
  select q.vec_id as query_id, r.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])), 0)::bigint as score
  from rows q join rows r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0
),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query
def op7_template_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.main_text(table(spark, sf, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    return toxicity.scored(docs, labels, learn=part != 1).select(
        "doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op4_ppm(spark: SparkSession, sf: str) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))
    scored, tokens, distinct = ppm.scored(table(spark, sf, "documents").select("doc_id", "text"), learn=part != 2)
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return scored.select(
        "doc_id",
        (part == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


@query
def op8_packed_ids(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = tokenizer_files()
    ranks = bpe.read_ranks(path)
    encoded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, pattern)
    # all ranks are under 65,536
    return packing.packed(encoded, length=2048, pad=0, kind="<u2")


@query
def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    linked = alignment.linked(docs, *files)
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = stored(linked.withColumn("groups_sha256", groups).drop("text", "groups"), "linked")
    return alignment.counted(rows).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    docs, target = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text")
    drawn = importance.resampled(docs, target, share=(5, 100), min_words=20, seed=42, keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return counting.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )

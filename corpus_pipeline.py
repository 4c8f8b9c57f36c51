"""A training-data pipeline over ``documents``: every stage reads what the stage before it wrote.

quality -> near copies -> repeated passages -> mixing -> token ids. All but the last return the columns of their
input. Columns are renamed inside a stage, so columns of any names may stand beside doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm import bpe, mixing, quality, simhash, substrings
from trustlake.llm.common import stored
from trustlake.llm.queries import table, tokenizer_files


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns _c0, _c1, ..; and the new name of each old one."""
    names = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep. Empty and null texts go."""
    rows, names = _renamed(docs)
    judged = quality.judged(stored(quality.measured(rows, names["text"]), "measures"), names["source"])
    return judged.filter("kept").select(*names.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8), the one of the smallest id."""
    rows, names = _renamed(docs)
    kept = simhash.first_of_near_copies(rows, names["doc_id"], names["text"], shingle=5, similarity=0.8)
    return kept.select(*names.values()).toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; texts that lose nothing stay as they are.

    A document that loses all its words stays with an empty text; n_chars, if there, is counted again.
    """
    rows, names = _renamed(docs)
    found = substrings.without_repeats(rows, names["doc_id"], names["text"])
    changed = F.col("n_removed") > 0
    out = found.withColumn(names["text"], F.when(changed, F.col("kept")).otherwise(F.col(names["text"])))
    if "n_chars" in names:
        count = F.length(names["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(names["n_chars"], F.when(changed, count).otherwise(F.col(names["n_chars"])))
    return out.select(*names.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows, names = _renamed(docs)
    mixed = mixing.mix(rows, names["doc_id"], names["text"], names["source"])
    taken = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*names.values()).toDF(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256) of each document; the digest is of the decoded ids."""
    path, pattern = tokenizer_files()
    ranks = bpe.read_ranks(path)
    return bpe.round_trip(docs.select("doc_id", "source", "text"), ranks, pattern).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("token_ids", encode_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the fingerprints nor the merges of the tokenizer.
ORACLE_SQL = None

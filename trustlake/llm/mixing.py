"""Mixing sources to target weights with hash-threshold histograms.

The size of a document is its number of words. Every source gets a target; whole passes over the source cover
the whole multiples of its size, and a further part pass takes the documents whose hash lies under a threshold.
The threshold comes from a histogram: sizes are summed by (source, hash bucket), the running sum finds the bucket
in which the budget ends, and only the documents of that one bucket are looked at again with the next bits of
the hash. After the last round the boundary holds one hash value (in practice one document), which goes in if
that brings the sum nearer to the budget. Documents are never sorted; what is carried between the rounds has at
most ``BUCKETS`` rows a source. The hash depends on the id and the text, so reruns agree, and the documents of a
larger budget hold those of a smaller one.

Defined cases: a null text has size 0; the null source is a source of its own and comes last; rows with equal
id and text share a hash and are taken or left together; a document of size 0 is never counted as taken; an
empty table gives no rows. Extra columns are passed through by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake.llm.common import n_words, named_back, renamed, stored

#: Four hexadecimal digits of the hash a round, twelve digits in all.
DIGITS, ROUNDS = 3, 4
BUCKETS = 16**DIGITS


def hash_digits(doc_id: str, text: str) -> Column:
    """The first hexadecimal digits of the MD5 of id and text; null counts as empty."""
    whole = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.substring(F.md5(whole), 1, DIGITS * ROUNDS)


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) of each source.

    ``sizes`` has (source, source_size), one row a source. Sources in order of their code points, null last, get
    ``weights`` in turn and split ``share`` of all sizes by weight; a target stops at ``most`` times the size of
    its source, and what is over is split again by weight among the others until none is above. There are as
    many passes as sources reach their stop in turn; each reads two sums.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    # position without a one-task window: the partitions of the sort are numbered, and each one's rows counted
    placed = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "sources")
    per_part = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = placed.withColumn("_part", F.shiftright("_at", 33)).join(per_part.withColumn("_before", before), "_part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    weighed = stored(
        rank.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .select("source", "source_size", weight.cast("double").alias("weight")),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    stop = F.col("source_size") * F.lit(float(most))
    level, budget = 0.0, float(share) * total
    while True:
        open_ = stop > F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, stop)).alias("stopped")
        ).first()
        if not row.w:
            break
        following = (budget - (row.stopped or 0.0)) / row.w
        if following <= level:
            break
        level = following
    return weighed.select("source", "source_size", F.least(stop, F.col("weight") * F.lit(level)).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, passes, limit): whole passes over each source, and the hash under which one more is made.

    ``docs`` has (source, size, hash), ``budgets`` (source, source_size, target). ``limit`` is compared with the
    hash as strings of digits; a document goes in if its hash is smaller.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = budgets.select(
        "source",
        passes.cast("long").alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("rest"),
        F.lit("").alias("prefix"),
        F.lit(0).cast("long").alias("last_size"),
    )
    for _ in range(ROUNDS):
        state = stored(_refined(docs, state), "thresholds")
    # what is left at the boundary is one hash value: it goes in if that is nearer
    end = F.when(F.col("rest") * 2 >= F.col("last_size"), F.concat("prefix", F.lit("g"))).otherwise(F.col("prefix"))
    return state.select("source", "passes", end.alias("limit"))


def _refined(docs: DataFrame, state: DataFrame) -> DataFrame:
    """One round: the histogram of the boundary bucket of each source by the next digits."""
    depth = F.length("prefix")
    inside = docs.join(state.select(F.col("source").alias("_s"), "prefix"), F.col("source").eqNullSafe(F.col("_s"))).filter(
        F.substring("hash", 1, DIGITS * ROUNDS).startswith(F.col("prefix"))
    )
    sums = inside.groupBy("source", "prefix", F.substr("hash", depth + 1, F.lit(DIGITS)).alias("digits")).agg(
        F.sum("size").alias("bucket")
    )
    # at most BUCKETS rows a source
    ordered = Window.partitionBy("source").orderBy("digits")
    earlier = F.coalesce(F.sum("bucket").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = sums.select("source", "digits", "bucket", earlier.alias("before")).select(
        F.col("source").alias("_s"), "digits", "bucket", "before"
    )
    # the last bucket that starts at or under the rest holds the boundary
    joined = state.join(running, F.col("source").eqNullSafe(F.col("_s")) & (F.col("before") <= F.col("rest")), "left")
    best = joined.groupBy("source", "passes", "rest", "prefix").agg(
        F.max(F.when(F.col("digits").isNotNull(), F.struct("digits", "before", "bucket"))).alias("at")
    )
    return best.select(
        "source",
        "passes",
        (F.col("rest") - F.coalesce("at.before", F.lit(0))).alias("rest"),
        F.concat("prefix", F.coalesce("at.digits", F.lit("0" * DIGITS))).alias("prefix"),
        F.coalesce("at.bucket", F.lit(0)).cast("long").alias("last_size"),
    )


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``df`` with size, source_size, target (of the source) and copies (how often the mix takes the document).

    The four columns replace columns of the same names. No document has more than ``most`` copies, rounded up.
    """
    made = ("size", "source_size", "target", "copies")
    rows, names = renamed(df)
    doc_id, text, source = names[doc_id], names[text], names[source]
    # ids, sizes and hashes are small next to the texts and are read six times
    docs = stored(
        rows.select(F.col(source).alias("source"), n_words(text).alias("size"), hash_digits(doc_id, text).alias("hash")), "sizes"
    )
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, share, most), "targets")
    ends = thresholds(docs, goals)
    plan = goals.join(ends.withColumnRenamed("source", "_e"), F.col("source").eqNullSafe(F.col("_e"))).drop("_e")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)
    out = (
        rows.withColumns({"size": n_words(text), "hash": hash_digits(doc_id, text)})
        .join(plan, F.col(source).eqNullSafe(F.col("source")))
        # documents of size 0 lie under every limit before the first word, a limit of nothing included
        .withColumn("copies", F.least(copies, F.lit(math.ceil(most))).cast("long"))
    )
    return named_back(out, names, made)

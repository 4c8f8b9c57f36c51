"""Importance resampling towards a target distribution, with distributed quickselect.

Features are runs of one to three words, hashed into ``BUCKETS`` buckets. Every task counts the buckets of its texts in
one array, and the arrays are summed by bucket. A bucket's gain is a whole number, a thousand times the log ratio of
its smoothed shares in the target and in the table; the gains are one array of ``BUCKETS`` numbers, which is
broadcast, and a text's weight is the sum of the gains at its features. Gumbel noise from a hash of the id turns the
largest scores into a draw without replacement.

The k largest are found without sorting the table. Keys are unique and totally ordered: score downwards, id upwards,
then the place of the row in the written scores. In each round ``PIVOTS`` random keys of the open interval split it, and
one pass counts the rows below, at and above each pivot exactly and draws the pivots of every part; only the part that
holds the k-th key stays open, so the driver gets (pivots x parts) rows a round, whatever the table's size. The winners
alone are then ranked: random winners cut them into slices of about ``SLICE_ROWS`` rows, the slices are counted, and
each is sorted by itself.

Words: A-Z lowered, runs of characters other than ASCII ones that are no digit or letter. Weights and scores are long.

Defined cases: a null or empty text has no features and weight 0; texts with fewer than ``min_words`` words have scores
but are never drawn; a null id hashes as the empty text and comes after all others of its score; rows with equal
scores and ids (repeated rows) are drawn in the order in which their scores were written, each for itself; empty tables
give no rows, and an empty target no features (all gains follow from the smoothing). Extra columns are passed through,
and added columns replace columns of their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.llm.common import adding, bytes_or_empty, parts, renamed, stored

BUCKETS, SMOOTHING, SCALE = 10_000, 1, 1000
#: Pivots of a round of the selection; rows of a slice of winners, and slices at most (the slices grow beyond).
PIVOTS, SLICE_ROWS, SLICES = 32, 100_000, 2_048

#: Letters and digits of ASCII and all bytes of other characters as they are, every other byte a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split()


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The buckets of all runs of one to three words; a longer run's checksum goes on from the shorter one's."""
    one = list(map(crc32, words))
    following = [b" " + w for w in words[1:]]
    two = list(map(crc32, following, one))
    three = list(map(crc32, following[1:], two))
    return np.array(one + two + three, np.int64) % BUCKETS


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in parts(batches):
            for t in bytes_or_empty(batch.column(0)):
                sums += np.bincount(buckets_of(words_of(t)), minlength=BUCKETS)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    # at most BUCKETS rows
    rows = df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from the feature counts of the table and of the target."""
    all_source, all_target = float(source.sum()), float(target.sum())
    spread = float(SMOOTHING * BUCKETS)
    ratio = ((target + SMOOTHING) * (all_source + spread)) / ((source + SMOOTHING) * (all_target + spread))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio.tolist()], np.int64)


def weighted(df: DataFrame, gains: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_features and weight of its whole texts."""
    shared = df.sparkSession.sparkContext.broadcast(gains)
    added = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "n_features", "weight")])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        gain = shared.value
        for batch in batches:
            found = np.zeros((3, batch.num_rows), np.int64)
            for i, t in enumerate(bytes_or_empty(batch.column(text))):
                words = words_of(t)
                buckets = buckets_of(words)
                found[:, i] = len(words), len(buckets), gain[buckets].sum()
            yield batch, [pa.array(row) for row in found]

    return adding(df, added, columns)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times Gumbel noise, rounded down, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _literal(value: tuple, rows: DataFrame, fields: list[str]) -> Column:
    return F.struct(*[F.lit(v).cast(rows.schema[f].dataType).alias(f) for v, f in zip(value, fields)])


def _split(rows: DataFrame, fields: list[str], pivots: list[tuple], strict: bool = False) -> Column:
    """Number of pivots under the key (with ``strict``) or under and at it."""
    if not pivots:
        return F.lit(0)
    key, values = F.struct(*fields), F.array(*[_literal(p, rows, fields) for p in pivots])
    return F.size(F.filter(values, (lambda p: p < key) if strict else (lambda p: p <= key)))


def _random(fields: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *fields)


def kth_key(rows: DataFrame, fields: list[str], k: int, seed: int = 0) -> tuple | None:
    """The k-th smallest of the unique keys made of ``fields`` (from 1), None if there are fewer rows.

    Each round reads the open interval once: rows are counted by the part between or at the pivots, and every part
    hands over its own random keys, by smallest hash in each of ``PIVOTS`` hash classes.
    """
    key = F.struct(*fields)
    inside, before, pivots, turn = F.lit(True), 0, [], seed
    while True:
        turn += 1
        draw = _random(fields, turn)
        # even parts lie between pivots, odd ones are the pivots themselves
        part = (_split(rows, fields, pivots) + _split(rows, fields, pivots, strict=True)).alias("part")
        found = (
            rows.filter(inside)
            .groupBy(part, F.pmod(draw, F.lit(PIVOTS)).alias("of"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(draw.alias("draw"), key.alias("key"))).alias("at"))
            .collect()
        )
        at = before
        for number in sorted({r.part for r in found}):
            mine = [r for r in found if r.part == number]
            count = sum(r.n for r in mine)
            if at + count >= k:
                break
            at += count
        else:
            return None
        if count == 1:
            return tuple(mine[0].at.key)
        if number % 2 == 0:
            half = number // 2
            low, high = pivots[half - 1 : half], pivots[half : half + 1]
            for p in low:
                inside = inside & (key > _literal(p, rows, fields))
            for p in high:
                inside = inside & (key < _literal(p, rows, fields))
        before = at
        pivots = sorted((tuple(r.at.key) for r in mine), key=_order)


def _order(key: tuple) -> tuple:
    """Spark's order of structs: null before all values."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in key)


def ranked(rows: DataFrame, fields: list[str], n: int, name: str = "rank", seed: int = 0) -> DataFrame:
    """``rows`` with their rank (from 1) by the unique keys of ``fields``; there are ``n`` rows."""
    slices = max(1, min(SLICES, -(-n // SLICE_ROWS)))
    bounds: list = []
    if slices > 1:
        draw = _random(fields, seed)
        picked = rows.groupBy(F.pmod(draw, F.lit(slices - 1)).alias("of")).agg(F.min(F.struct(draw.alias("draw"), F.struct(*fields).alias("key"))).alias("at"))
        bounds = sorted((tuple(r["at"]["key"]) for r in picked.collect()), key=_order)
    cut = rows.withColumn("_slice", _split(rows, fields, bounds))
    sizes = {r["_slice"]: r["count"] for r in cut.groupBy("_slice").count().collect()} if bounds else {}
    starts = np.cumsum([0, *[sizes.get(i, 0) for i in range(len(bounds))]]).tolist()
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("_slice") + 1)
    return cut.withColumn(name, (start + F.row_number().over(Window.partitionBy("_slice").orderBy(*fields))).cast("long")).drop("_slice")


def resampled(
    df: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: tuple[int, int] = (5, 100),
    min_words: int = 20,
    seed: int = 42,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with n_words, n_features, weight, score and rank; rank is null where a row isn't drawn.

    Of the N rows with at least ``min_words`` words, floor(``share`` * N) are drawn. ``keep`` names the columns of ``df``
    that are written and returned (all if not given), so that texts need not be.
    """
    gains = gains_of(bucket_counts(df, text), bucket_counts(target, target_text))
    made = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    rows, names = renamed(df)
    scored = weighted(rows, gains, names[text]).withColumn("score", F.col("weight") + gumbel(F.col(names[doc_id]), seed))
    written = stored(scored.select(F.col(names[doc_id]).alias("_id"), *[names[c] for c in kept], *made[:-1]), "scores")
    placed = written.select(
        "*",
        (-F.col("score")).alias("_down"),
        F.col("_id").isNull().alias("_none"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    fields = ["_down", "_none", "_id", "_file", "_row"]
    fit = F.col("n_words") >= min_words
    k = share[0] * placed.filter(fit).count() // share[1]
    last = kth_key(placed.filter(fit), fields, k, seed) if k else None
    drawn = F.lit(False) if last is None else fit & (F.struct(*fields) <= _literal(last, placed, fields))
    winners = ranked(placed.filter(drawn), fields, k, seed=seed)
    others = placed.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    out = winners.unionByName(others)
    return out.select(*[F.col(names[c]).alias(c) for c in kept], *made)

"""Joins of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join on ``keys`` with the rows of every key dealt out over ``salts`` parts.

    For a join that is followed by a grouping on the same keys. Without the salt
    the grouping would reuse the join's partitioning, which keeps a hot key in
    one task and also forbids adaptive execution to split it. With it the
    grouping combines per part first, and parts that are still large may be split.
    ``per_key`` is copied ``salts`` times, so it should have one row per key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")

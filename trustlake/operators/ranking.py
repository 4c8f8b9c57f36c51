"""Ordered computations that never put a whole key into one task.

A window over ``partitionBy(action)`` sends every row of an action to one task.
Here the rows are cut into ordered slices of about equal size, each (key, slice)
is summed, the sums are carried forward over the slices (at most one row per key
and slice), and the row-level window only runs inside one (key, slice).

A slice is a function of the row: the number of bounds before it, and the bounds
are constants taken from a sample of the order columns. So nothing is
written, every reader of the rows gives a row the same slice, and the number of
slices follows the number of rows. The carried-forward sums enter the row window as
extra leading rows, so the rows are shuffled once and no join is needed.

Single positions (quantiles, medians, cuts) need no order at all: ``select_at`` counts
rows between pivots, pass by pass, and neither shuffles nor writes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
#: Rows of a slice, about, and sampled rows for each bound; the driver holds the sample.
SLICE_ROWS, SAMPLES = 250_000, 32
#: Equal parts of an open interval of numbers, pivots drawn for one of other values, and rows that are looked at one by one.
BUCKETS, PIVOTS, DIRECT = 1024, 256, 2_000


@dataclass(frozen=True)
class Term:
    """One column of an order."""

    value: Column
    descending: bool = False

    def before(self, a: Column, b: Column) -> Column:
        """Nulls come first, and last in descending order, as in a sort."""
        if self.descending:
            return F.coalesce(a > b, a.isNotNull() & b.isNull())
        return F.coalesce(a < b, a.isNull() & b.isNotNull())


def terms(order: Sequence[str | Column]) -> list[Term]:
    """Names, expressions, and ``desc``/``asc`` of names."""
    out = []
    for item in order:
        sort = re.fullmatch(r"Column<'(.*) (ASC NULLS FIRST|DESC NULLS LAST)'>", str(item), re.S)
        if isinstance(item, str):
            out.append(Term(F.col(item)))
        elif sort:
            out.append(Term(F.col(sort[1]), sort[2].startswith("DESC")))
        else:
            out.append(Term(item))
    return out


def _before_key(order: list[Term], a: Column, b: list[Column]) -> Column:
    """Does the struct ``a`` come before the columns ``b``?"""
    out = None
    for i in range(len(order) - 1, -1, -1):
        mine = a[f"f{i}"]
        here = order[i].before(mine, b[i])
        out = here if out is None else here | (mine.eqNullSafe(b[i]) & out)
    return out


def bounds_before(order: list[Term], bounds: Column | list[Column]) -> Column:
    """How many of the sorted ``bounds`` (structs f0, f1, ..) come before the row, in two short searches."""
    columns = [t.value for t in order]

    def count(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: _before_key(order, b, columns)))

    if len(bounds) <= 32:
        return count(F.array(*bounds)) if bounds else F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    # the last bound of each block says in which one the row is; only that one is searched
    block = count(F.array(*[b[-1] for b in blocks]))
    inside = F.coalesce(count(F.get(F.array(*[F.array(*b) for b in blocks]), block)), F.lit(0))
    return F.least(block * step, F.lit(len(bounds))) + inside


def _literals(df: DataFrame, order: list[Term], keys: Sequence[tuple]) -> list[Column]:
    """Keys of ``order`` as constants of the columns' types."""
    types = [f.dataType for f in df.select(*[t.value for t in order]).schema]
    return [
        F.struct(*[F.lit(v).cast(kind).alias(f"f{i}") for i, (v, kind) in enumerate(zip(key, types))]) for key in keys
    ]


def _sorted(order: list[Term], keys: Sequence[tuple]) -> list[tuple]:
    out = list(keys)
    for i in range(len(order) - 1, -1, -1):
        # nulls first going up, last going down; NaN is the largest number
        out.sort(key=lambda k: (0, 0) if k[i] is None else (2, 0) if k[i] != k[i] else (1, k[i]), reverse=order[i].descending)
    return out


def _sample(df: DataFrame, order: list[Term], one_in: int, seed: int) -> list[tuple]:
    """The keys of about one row in ``one_in``."""
    keys = df.select(*[t.value.alias(f"f{i}") for i, t in enumerate(order)])
    if one_in > 1:
        keys = keys.filter(F.rand(seed) * one_in < 1)
    return [tuple(r) for r in keys.collect()]


def slice_rows(df: DataFrame, order: Sequence[str | Column], slices: int | None = None) -> DataFrame:
    """Tag every row with the number of its slice in the total order ``order``.

    ``order`` should end in a unique column, so that equal leading values can be
    cut as well. The order columns are read once to count them and, if there is more than
    one slice, once to sample the bounds; nothing is written. Make an input that is expensive to compute
    ``durable`` first.
    """
    by = terms(order)
    total = df.select(*[t.value for t in by]).count()
    n = slices or -(-total // SLICE_ROWS)
    if n <= 1:
        return df.withColumn(SLICE, F.lit(0))
    drawn = _sorted(by, set(_sample(df, by, max(1, total // (n * SAMPLES)), n)))
    bounds = sorted({len(drawn) * i // n for i in range(1, n)}) if drawn else []
    return df.withColumn(SLICE, bounds_before(by, _literals(df, by, [drawn[i] for i in bounds])))


def _before(column: str, keys: Sequence[str]) -> Column:
    spec = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(spec), F.lit(0))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    totals: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Per row: each sum over all earlier rows of the same key, own row excluded.

    ``order`` must be a total order within the key. With ``totals`` the sum over
    the whole key is added as ``<name>_total``.
    """
    names = list(sums)
    valued = df.withColumns({f"_v_{n}": e for n, e in sums.items()})
    rows = slice_rows(valued, order, slices)

    per_slice = rows.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    whole = Window.partitionBy(*keys)
    lead = per_slice.select(
        *keys,
        SLICE,
        F.lit(0).alias("_seq"),
        *[_before(f"_s_{n}", keys).alias(f"_v_{n}") for n in names],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []),
    )

    inside = Window.partitionBy(*keys, SLICE).orderBy(F.col("_seq"), *order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_seq", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    out = {n: F.sum(f"_v_{n}").over(earlier) for n in names}
    if totals:
        first = inside.rowsBetween(Window.unboundedPreceding, 0)
        out |= {f"{n}_total": F.first(f"{n}_total", ignorenulls=True).over(first) for n in names}
    return both.withColumns(out).filter("_seq = 1").drop("_seq", SLICE, *[f"_v_{n}" for n in names])


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str, slices: int | None = None
) -> DataFrame:
    """Per row: the last ``value`` that is not null among the key's rows up to and with this one.

    The last value of each (key, slice) is carried forward over the slices, as one leading row.
    """
    rows = slice_rows(df.withColumn("_value", value), order, slices)
    by = terms(order)
    columns = {f"_o{i}": t.value for i, t in enumerate(by)}
    known = rows.filter(F.col("_value").isNotNull()).withColumns(columns)
    if any(t.descending for t in by):
        raise ValueError("last_known needs an ascending order")
    ends = known.groupBy(*keys, SLICE).agg(F.max_by("_value", F.struct(*columns)).alias("_end"))
    places = rows.select(*keys, SLICE).distinct()
    carried = places.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).unionByName(ends)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rangeBetween(Window.unboundedPreceding, -1)
    lead = (
        carried.withColumn("_value", F.last("_end", ignorenulls=True).over(earlier))
        .groupBy(*keys, SLICE)
        .agg(F.first("_value", ignorenulls=True).alias("_value"))
        .withColumn("_seq", F.lit(0))
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy("_seq", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_seq", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    return both.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).filter("_seq = 1").drop("_seq", SLICE, "_value")


def global_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank0", totals: bool = False
) -> DataFrame:
    """Zero-based position of every row within its key; ``<name>_total`` is the key's row count."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, totals=totals)


def strict_history(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, sums: dict[str, Column], slices: int | None = None
) -> DataFrame:
    """Per row: each sum over the rows of the same key with a strictly smaller ``ts``.

    Rows with an equal ``ts`` (peers) do not see one another. A value of ``ts``
    that is common enough to reach over several slices is handled by a
    correction per (key, slice): the carried-forward sum first leaves out the
    peers in earlier slices and adds them for larger ``ts`` only. ``ts`` must be
    an integer column.
    """
    names = list(sums)
    rows = slice_rows(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), [ts, tie], slices)
    # one row per slice, so the size of the broadcast is the number of slices
    bounds = rows.groupBy(SLICE).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    per_slice = (
        rows.select(*keys, SLICE, ts, *[f"_v_{n}" for n in names])
        .join(F.broadcast(bounds), SLICE)
        .groupBy(*keys, SLICE, "_lo", "_hi")
        .agg(
            *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names],
            *[F.sum(F.when(F.col(ts) == F.col("_hi"), F.col(f"_v_{n}")).otherwise(0)).alias(f"_t_{n}") for n in names],
        )
    )
    # peers of the slice's smallest ts that sit in earlier slices of the key
    ends = per_slice.select(
        *keys, SLICE, F.col("_hi").alias("_at"), F.lit(0).alias("_ask"),
        *[F.col(f"_t_{n}") for n in names], *[F.lit(0).alias(f"_b_{n}") for n in names],
    )
    asks = per_slice.select(
        *keys, SLICE, F.col("_lo").alias("_at"), F.lit(1).alias("_ask"),
        *[F.lit(0).alias(f"_t_{n}") for n in names],
        *[_before(f"_s_{n}", keys).alias(f"_b_{n}") for n in names],
    )
    peers = Window.partitionBy(*keys, "_at").orderBy(SLICE).rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.unionByName(asks)
        .withColumns({f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(peers), F.lit(0)) for n in names})
        .filter("_ask = 1")
    )
    lead = carried.select(
        *keys,
        SLICE,
        F.explode(
            F.array(
                F.struct(
                    (F.col("_at") - 1).alias(ts),
                    *[(F.col(f"_b_{n}") - F.col(f"_c_{n}")).alias(f"_v_{n}") for n in names],
                ),
                F.struct(F.col("_at").alias(ts), *[F.col(f"_c_{n}").alias(f"_v_{n}") for n in names]),
            )
        ).alias("_p"),
    ).select(*keys, SLICE, F.lit(0).alias("_seq"), "_p.*")

    earlier = (
        Window.partitionBy(*keys, SLICE).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    )
    both = rows.withColumn("_seq", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    return (
        both.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)) for n in names})
        .filter("_seq = 1")
        .drop("_seq", SLICE, *[f"_v_{n}" for n in names])
    )


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None
) -> DataFrame:
    """One row per distinct (key, value): its count ``n``, the number of smaller
    values ``before`` and the key's size ``n_total``.

    Equal values are counted before anything is ordered, so a value held by a
    third of the rows costs one row. Average rank, order statistics, nearest-rank
    percentiles and quantile edges all follow by arithmetic. ``weight`` counts a row of ``df`` more than once.
    """
    count = weight if weight is not None else F.lit(1).cast("bigint")
    counts = df.groupBy(*keys, value).agg(F.sum(count).alias("n"))
    ranked = running_sums(counts, keys, [value, *keys], {"before": F.col("n")}, totals=True)
    return ranked.withColumnRenamed("before_total", "n_total")


def equal_frequency_bin(rank0: Column, total: Column, bins: int) -> Column:
    """Bin of a zero-based rank: ``total div k`` rows each, the first ``total mod k`` bins get one more."""
    k = F.least(F.lit(bins).cast("bigint"), total)
    size = F.floor(total / k)
    extra = total - size * k
    cut = extra * (size + 1)
    return F.when(rank0 < cut, F.floor(rank0 / (size + 1))).otherwise(extra + F.floor((rank0 - cut) / size)).cast("int")


def last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], salts: int | None = None
) -> DataFrame:
    """The ``n`` leading rows of every key under ``order``.

    Two rounds: within (key, salt), then within the key, so that the second
    round sees at most ``n * salts`` rows of one key. The number of salts follows
    the number of shuffle partitions.
    """
    salts = salts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(second))
        .filter(F.col("_rn") <= n)
        .withColumnRenamed("_rn", "position")
        .drop("_salt")
    )


def rolling_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, rows: int, name: str,
    slices: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over the current and the ``rows - 1`` preceding rows of the key.

    The last ``rows - 1`` rows of each (key, slice) are its halo. A halo row goes to the following
    slices of its key until ``rows - 1`` rows lie between, which is the next one unless that is
    short. The halo is cut down on the map side, so the rows themselves are shuffled once.
    """
    sliced = slice_rows(df.withColumn("_value", value), order, slices)
    at = [f"_o{i}" for i in range(len(order))]
    by = terms(order)
    ordered = [F.col(a).desc() if t.descending else F.col(a).asc() for a, t in zip(at, by)]
    backwards = [F.col(a).asc_nulls_last() if t.descending else F.col(a).desc_nulls_last() for a, t in zip(at, by)]
    narrow = sliced.select(*keys, SLICE, "_value", *[t.value.alias(a) for a, t in zip(at, by)])
    tail = (
        narrow.withColumn("_back", F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*backwards)))
        .filter(F.col("_back") < rows)
    )
    # per (key, slice): the following slices with the number of rows in between, as long as these are too few
    sizes = narrow.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    following = F.collect_list(F.struct(F.col(SLICE).alias("to"), F.col("_n").alias("n"))).over(along.rowsBetween(1, rows - 1))
    between = F.aggregate(F.slice("_next", 1, F.col("_i")), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    links = (
        sizes.withColumn("_next", following)
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(SLICE).alias("_from"), "_next", F.posexplode("_next").alias("_i", "_e"))
        .withColumn("_between", between)
        .filter(F.col("_between") < rows - 1)
        .select(*[f"_k{i}" for i in range(len(keys))], "_from", F.col("_e.to").alias("_to"), "_between")
    )
    same = F.col(SLICE) == F.col("_from")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    halo = (
        tail.join(links, same)
        .filter(F.col("_back") + F.col("_between") < rows)
        .select(*keys, F.col("_to").alias(SLICE), "_value", *at, F.lit(True).alias("_halo"))
    )
    both = sliced.withColumns({a: t.value for a, t in zip(at, by)}).withColumn("_halo", F.lit(False)).unionByName(
        halo, allowMissingColumns=True
    )
    spec = Window.partitionBy(*keys, SLICE).orderBy(*ordered).rowsBetween(-(rows - 1), 0)
    return both.withColumn(name, F.sum("_value").over(spec)).filter(~F.col("_halo")).drop("_halo", "_value", SLICE, *at)


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Per key the values at zero-based sorted positions, exactly.

    A position is an expression over ``n_total``, the key's number of values.
    Output: one row per key with ``n_total`` and one column per position; without keys the
    positions are selected (``select_at``) and come back as constants.
    """
    known = df.filter(F.col(value).isNotNull())
    if not keys:
        spark = df.sparkSession
        found = select_at(known, [value], lambda n, _: evaluated(spark, list(positions.values()), n)).get(None)
        n, picked = found or (0, [None] * len(positions))
        kind = df.schema[value].dataType
        return spark.range(1 if n else 0).select(
            F.lit(n).cast("bigint").alias("n_total"),
            *[F.lit(None if at is None else at[0]).cast(kind).alias(name) for name, at in zip(positions, picked)],
        )
    ranked = value_ranks(known, keys, value)
    picked = [
        F.max(F.when(at.between(F.col("before"), F.col("before") + F.col("n") - 1), F.col(value))).alias(name)
        for name, at in positions.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n_total").alias("n_total"), *picked)


def evaluated(spark: SparkSession, positions: Sequence[Column], n: int) -> list[int]:
    """Positions as numbers, from expressions over ``n_total``."""
    one = spark.range(1).select(F.lit(n).cast("bigint").alias("n_total"))
    row = one.select(*[p.cast("bigint").alias(f"p{i}") for i, p in enumerate(positions)]).first()
    return list(row)


@dataclass
class Interval:
    """An open interval of a group: its ends (None at the outside), the rows before it, and its own rows."""

    low: tuple | None
    high: tuple | None
    before: int
    n: int


def select_at(
    df: DataFrame, order: Sequence[str | Column], positions: Callable[[int, object], Sequence[int]], group: str | None = None
) -> dict:
    """The keys at zero-based positions of each group's order: {group: (number of rows, [key or None beyond the end])}.
    ``positions`` gives them from a group's number of rows and the group.

    Works by refinement, column by column of the order. For a number, a pass counts the rows in ``BUCKETS`` equal parts of
    every open interval of values, with the least and greatest value of each part; only the part that holds a position stays open, between these
    two, until one value is left. Rows that share it are told apart by the next columns. Columns of other types are refined
    by random pivots. What is left of ``DIRECT`` rows or less is looked at itself. Rows are neither shuffled nor written; the
    driver holds counts and those last rows, whose number depends on the positions and groups only. ``group`` should
    have few values.
    """
    by = terms(order)
    of = F.lit("") if group is None else F.col(group)
    rows = df.select(of.alias("_group"), *[t.value.alias(f"f{i}") for i, t in enumerate(by)])
    by = [Term(F.col(f"f{i}"), t.descending) for i, t in enumerate(by)]
    if isinstance(rows.schema["f0"].dataType, T.NumericType) and not by[0].descending:
        sizes, found, wanted = _select_numbers(rows, by, positions)
        return {None if group is None else g: (n, [found[g].get(p) for p in wanted[g]]) for g, n in sizes.items()}
    sizes = {r["_group"]: r["n"] for r in rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {g: list(positions(n, g)) for g, n in sizes.items()}
    found: dict = {g: {} for g in sizes}
    open_ = {g: [Interval(None, None, 0, n)] for g, n in sizes.items() if any(0 <= p < n for p in wanted[g])}
    seed = 0
    while open_:
        seed += 1
        open_ = _refined(rows, by, open_, wanted, found, seed)
    return {None if group is None else g: (n, [found[g].get(p) for p in wanted[g]]) for g, n in sizes.items()}


def _select_numbers(rows: DataFrame, by: list[Term], positions: Callable) -> tuple[dict, dict, dict]:
    """(rows, keys by position, positions) of each group; the first column is a number."""
    v = F.col("f0")
    kind = rows.schema["f0"].dataType
    # nulls first, then what has no place on a line: both infinities, and NaN as the greatest
    special = F.when(v.isNull(), 0)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        special = special.when(F.isnan(v), 4).when(v == float("-inf"), 1).when(v == float("inf"), 3)
    special = special.otherwise(2)
    ends = rows.groupBy("_group", special.alias("_kind")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    sizes: dict = {}
    held: dict = {}  # group -> (first position, rows, least, greatest) in order
    for r in sorted(ends.collect(), key=lambda r: r["_kind"]):
        held.setdefault(r["_group"], []).append((sizes.get(r["_group"], 0), r["n"], r["lo"], r["hi"]))
        sizes[r["_group"]] = sizes.get(r["_group"], 0) + r["n"]
    wanted = {g: list(positions(n, g)) for g, n in sizes.items()}
    open_: list[tuple] = []  # group, first position, rows, least, greatest
    values: dict = {}  # group, position -> least and greatest value that it can have, their first position, their rows
    for g, parts in held.items():
        _sort_out([(g, *part) for part in parts], wanted[g], open_, values)
    while open_:
        number, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (g, _, _, lo, hi) in enumerate(open_):
            here = F.col("_group").eqNullSafe(F.lit(g)) & (v >= F.lit(lo)) & (v <= F.lit(hi))
            share = (v.cast("double") - F.lit(float(lo))) / F.lit(max(float(hi) - float(lo), 5e-324))
            number = F.when(here, F.lit(i)).otherwise(number)
            bucket = F.when(here, F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")).otherwise(bucket)
        counted = (
            rows.select(v, number.alias("_in"), bucket.alias("_bucket"))
            .filter("_in is not null")
            .groupBy("_in", "_bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
            .collect()
        )
        following: list[tuple] = []
        at = [x[1] for x in open_]
        for r in sorted(counted, key=lambda r: (r["_in"], r["_bucket"])):
            g = open_[r["_in"]][0]
            _sort_out([(g, at[r["_in"]], r["n"], r["lo"], r["hi"])], wanted[g], following, values)
            at[r["_in"]] += r["n"]
        open_ = following
    found: dict = {g: {} for g in sizes}
    # rows between two values, few of them, are looked at; among many rows of one value the next columns decide
    few: dict = {}
    large: dict = {}
    for (g, p), (lo, hi, first, n) in values.items():
        if len(by) == 1 and (lo is None or lo == hi or lo != lo):
            found[g][p] = (lo,)
        elif n <= DIRECT:
            few.setdefault((g, lo, hi, first), []).append(p)
        else:
            large.setdefault((g, lo, first), []).append(p)
    number = F.lit(None).cast("int")
    for i, (g, lo, hi, _) in enumerate(few):
        inside = v.eqNullSafe(F.lit(lo).cast(kind)) if lo is None or lo != lo else (v >= F.lit(lo)) & (v <= F.lit(hi))
        number = F.when(F.col("_group").eqNullSafe(F.lit(g)) & inside, F.lit(i)).otherwise(number)
    keys: dict = {}
    for r in rows.withColumn("_in", number).filter("_in is not null").collect() if few else []:
        keys.setdefault(r["_in"], []).append(tuple(r[f"f{k}"] for k in range(len(by))))
    for i, ((g, _, _, first), places) in enumerate(few.items()):
        mine = _sorted(by, keys[i])
        found[g].update({p: mine[p - first] for p in places})
    for (g, value, first), places in large.items():
        same = rows.filter(F.col("_group").eqNullSafe(F.lit(g)) & v.eqNullSafe(F.lit(value).cast(kind)))
        inside = select_at(same, [t.value if not t.descending else t.value.desc() for t in by[1:]], lambda n, _: [p - first for p in places])
        for p, key in zip(places, inside[None][1]):
            found[g][p] = (value, *key)
    return sizes, found, wanted


def _sort_out(parts: list[tuple], wanted: Sequence[int], open_: list, values: dict) -> None:
    """Parts (group, first position, rows, least, greatest) that hold a position: of one value or few rows they are done."""
    for g, first, n, lo, hi in parts:
        here = [p for p in wanted if first <= p < first + n]
        if here and (n <= DIRECT or lo is None or lo == hi or lo != lo):
            values.update({(g, p): (lo, hi, first, n) for p in here})
        elif here:
            open_.append((g, first, n, lo, hi))


def _placed(rows: DataFrame, by: list[Term], cuts: dict[object, tuple[list, list]], seed: int) -> DataFrame:
    """The rows with ``_part``, ``_info`` and a random ``_draw``, without those whose part has no info.

    ``cuts`` has each group's sorted cuts and an info for each part: part 2 i lies before cut i, part 2 i + 1 is cut i. It
    is a table of a row a group, which is broadcast.
    """
    step = max(2, int(max(len(c) for c, _ in cuts.values()) ** 0.5) + 1)
    key = T.StructType([rows.schema[f"f{i}"] for i in range(len(by))])
    schema = T.StructType(
        [
            T.StructField("_of", rows.schema["_group"].dataType),
            T.StructField("_heads", T.ArrayType(key)),
            T.StructField("_blocks", T.ArrayType(T.ArrayType(key))),
            T.StructField("_infos", T.ArrayType(T.LongType())),
        ]
    )
    table = []
    for g, (keys, infos) in cuts.items():
        blocks = [keys[i : i + step] for i in range(0, len(keys), step)]
        table.append((g, [b[-1] for b in blocks], blocks, infos))
    small = F.broadcast(rows.sparkSession.createDataFrame(table, schema))
    columns = [t.value for t in by]

    def before(array: Column) -> Column:
        return F.coalesce(F.size(F.filter(array, lambda k: _before_key(by, k, columns))), F.lit(0))

    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col("_cut")[f"f{i}"].eqNullSafe(c)
    return (
        rows.join(small, F.col("_group").eqNullSafe(F.col("_of")))
        .withColumn("_block", before(F.col("_heads")))
        .withColumn("_in", F.greatest(before(F.get("_blocks", F.col("_block"))), F.lit(0)))
        .withColumn("_cut", F.get(F.get("_blocks", F.col("_block")), F.col("_in")))
        .withColumn("_part", 2 * (F.col("_block") * step + F.col("_in")) + F.when(F.col("_cut").isNotNull() & same, 1).otherwise(0))
        # behind the last, shorter block
        .withColumn("_part", F.least(F.col("_part"), F.size("_infos") - 1))
        # a random number keeps the filters above the searches, which would be repeated in them otherwise
        .withColumns({"_info": F.get("_infos", F.col("_part")), "_draw": F.rand(seed)})
        .filter(F.col("_info").isNotNull())
        .drop("_of", "_heads", "_blocks", "_infos", "_block", "_in", "_cut")
    )


def _refined(rows: DataFrame, by: list[Term], intervals: dict, wanted: dict, found: dict, seed: int) -> dict:
    """One round: finds the positions in small intervals; gives the parts of the others that still hold one."""
    names = [f"f{k}" for k in range(len(by))]
    # one in so many rows of an interval is looked at: about PIVOTS, or all
    ends: dict = {}
    part_of: dict = {}
    for g, xs in intervals.items():
        cuts: list = []
        infos: list = []
        for x in xs:  # in order; two may meet in one cut
            if x.low is not None and (not cuts or cuts[-1] != x.low):
                infos += [None, None]
                cuts.append(x.low)
            part_of[g, 2 * len(cuts)] = x
            infos.append(1 if x.n <= DIRECT else max(1, x.n // PIVOTS))
            if x.high is not None:
                infos.append(None)
                cuts.append(x.high)
        infos += [None] * (2 * len(cuts) + 1 - len(infos))
        ends[g] = cuts, infos
    # drawn by row, so that a value that many rows hold is likely to be a pivot; any pivots give the same result
    held = _placed(rows, by, ends, seed).filter(F.col("_draw") * F.col("_info") < 1).collect()
    keys: dict = {}
    for r in held:
        keys.setdefault((r["_group"], r["_part"]), []).append(tuple(r[n] for n in names))

    cuts_of: dict = {}
    large: dict = {}
    for (g, part), x in part_of.items():
        mine = _sorted(by, keys.get((g, part), []))
        if x.n <= DIRECT:
            found[g].update({p: mine[p - x.before] for p in wanted[g] if x.before <= p < x.before + len(mine)})
        else:
            pivots = [k for i, k in enumerate(mine) if not i or mine[i - 1] != k]
            large.setdefault(g, []).append((x, pivots))
    if not large:
        return {}
    # the parts between and at the pivots are counted, each under its number
    numbered: dict = {}
    for g, xs in large.items():
        cuts, infos = [], []
        for i, (x, pivots) in enumerate(xs):
            if x.low is not None and (not cuts or cuts[-1] != x.low):
                infos += [None, None]
                cuts.append(x.low)
            for k in range(2 * len(pivots) + 1):
                numbered[g, 2 * len(cuts) + k] = i, k
            infos += [1] * (2 * len(pivots) + 1)
            cuts += pivots
            if x.high is not None:
                infos.append(None)
                cuts.append(x.high)
        infos += [None] * (2 * len(cuts) + 1 - len(infos))
        cuts_of[g] = cuts, infos
    counts: dict = {}
    for r in _placed(rows, by, cuts_of, seed).groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[(r["_group"], *numbered[r["_group"], r["_part"]])] = r["n"]
    following: dict = {}
    for g, xs in large.items():
        for i, (x, pivots) in enumerate(xs):
            before = x.before
            for k in range(2 * len(pivots) + 1):
                n = counts.get((g, i, k), 0)
                here = [p for p in wanted[g] if before <= p < before + n]
                if here and k % 2:
                    found[g].update(dict.fromkeys(here, pivots[k // 2]))
                elif here:
                    low = pivots[k // 2 - 1] if k else x.low
                    high = pivots[k // 2] if k // 2 < len(pivots) else x.high
                    following.setdefault(g, []).append(Interval(low, high, before, n))
                before += n
    return following


def half_even(x: Column) -> Column:
    """Nearest whole number, ties to the even one; plain arithmetic on doubles."""
    whole = F.floor(x)
    rest = x - whole
    up = (rest > 0.5) | ((rest == 0.5) & (whole % 2 != 0))
    return whole + up.cast("bigint")


def upper_median() -> Column:
    return F.floor(F.col("n_total") / 2)


def nearest_rank(q: float) -> Column:
    """Position round-half-even(q * (n - 1)), as a percentile without interpolation."""
    return F.least(F.col("n_total") - 1, half_even(F.lit(q) * (F.col("n_total") - 1)))


def cut_points(df: DataFrame, order: Sequence[str], positions: Sequence[Column]) -> list[dict | None]:
    """The order values of the rows at zero-based positions of the whole table, None beyond its end.

    A position is an expression over ``n_total``. The positions are selected (``select_at``), so no row moves; one row
    per position is used as a constant.
    """
    spark = df.sparkSession
    found = select_at(df, order, lambda n, _: evaluated(spark, positions, n)).get(None)
    keys = found[1] if found else [None] * len(positions)
    return [None if key is None else dict(zip(order, key)) for key in keys]


def before_cut(df: DataFrame, cut: dict | None) -> Column:
    """Does a row come before the cut in the cut's order? Before nothing when there is no cut."""
    if cut is None:
        return F.lit(True)
    types = dict(df.dtypes)
    constant = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in cut.items()])
    return F.struct(*[F.col(c) for c in cut]) < constant

"""Sampling turns for judging and for building a corpus. All draws are ordered by a hash, so they replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import BAND_NAMES, INTENT_MIX
from trustlake.operators.ranking import last_rows, select_at
from trustlake.session import durable


def draw_order(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def draw_keys(key: str) -> list[Column]:
    """The draw's order as a number, its first 60 bits, then whole, and the key itself."""
    return [F.conv(F.substring(draw_order(key), 1, 15), 16, 10).cast("bigint"), draw_order(key), F.col(key)]


def resume_pending(turns: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Turns that are not in the finished set yet."""
    return turns.join(done.select(key), key, "left_anti")


def _up_to(df: DataFrame, order: Sequence[Column], last: tuple | None) -> Column:
    """Does a row come before or at the key ``last`` of the order? No row does without one."""
    if last is None:
        return F.lit(False)
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]) <= F.struct(
        *[F.lit(v).cast(f.dataType).alias(f"k{i}") for i, (v, f) in enumerate(zip(last, df.select(*order).schema))]
    )


def first_rows(df: DataFrame, order: Sequence[Column], sizes: dict | int, group: str | None = None) -> Column:
    """Condition for the first rows in ``order``: ``sizes`` of them, of each ``group`` as many as it says.

    The last key that goes in is selected (``ranking.select_at``) and becomes a constant, so no row is sorted, ranked or
    moved, however many there are.
    """
    def last(n: int, g) -> list[int]:
        return [min(n, sizes if group is None else sizes.get(g, 0)) - 1]

    found = select_at(df, list(order), last, group)
    inside = F.lit(False)
    for g, (_, (key,)) in found.items():
        here = _up_to(df, order, key)
        inside = inside | (here if group is None else F.coalesce(F.col(group) == F.lit(g), F.lit(False)) & here)
    return inside


def quota_sample(df: DataFrame, stratum: str, key: str, strata: Sequence[str], total: int) -> DataFrame:
    """``total`` rows, an equal share from every stratum; what a stratum lacks is drawn from the rest.

    Rows are drawn by thresholds on the hash of the unique ``key``, one for each stratum and one for the rest. Rows outside the strata can
    only fill up.
    """
    share = total // len(strata)
    order = draw_keys(key)
    listed = F.coalesce(F.col(stratum).isin(*strata), F.lit(False))
    quota = listed & first_rows(df.filter(listed), order, dict.fromkeys(strata, share), stratum)
    taken = df.filter(quota).count()
    rest = ~quota & first_rows(df.filter(~quota), order, total - taken)
    return df.filter(quota | rest)


def turns_taken(sizes: Sequence[int], total: int) -> list[int]:
    """How many each of several queues gives when they take turns until ``total`` are taken, in closed form."""
    low, high = 0, max(sizes, default=0)
    while low < high:  # the most whole rounds
        middle = (low + high + 1) // 2
        if sum(min(n, middle) for n in sizes) <= total:
            low = middle
        else:
            high = middle - 1
    taken = [min(n, low) for n in sizes]
    over = total - sum(taken)
    for i, n in enumerate(sizes):
        if over > 0 and n > taken[i]:
            taken[i] += 1
            over -= 1
    return taken


def round_robin_sample(intents: DataFrame, key: str, total: int, mix=INTENT_MIX) -> DataFrame:
    """Orders for a corpus: the intent mix, each intent spread over the bands, an order used once.

    ``intents`` has one row per (order, intent) with its ``band``. The scarcest
    intent chooses first; within an intent the bands take turns, so a scarce
    band is used up before a plentiful one dominates. How many a band gives follows from
    the sizes of the cells, and which ones from a threshold on the hash; only sizes and
    thresholds reach the driver, and picked rows number at most ``total``.

    ``intents`` is computed once. The other intents take no more than all targets together, so no cell gives a row behind that many
    of its own; these leading rows are cut out first, and the turns are taken among them.
    """
    target = {name: int(round(total * share)) for name, share in mix}
    most = sum(target.values())
    wanted = durable(intents.filter(F.col("intent").isin(*target)).withColumn("_draw", draw_keys(key)[0]))
    counts = wanted.groupBy("intent", "band").agg(F.count("*").alias("n")).collect()
    sizes = {name: sum(r["n"] for r in counts if r["intent"] == name) for name in target}
    order = [F.col("_draw"), *draw_keys(key)[1:]]
    cells = wanted.filter(F.col("band").isin(*BAND_NAMES)).withColumn("_cell", F.concat_ws("|", "intent", "band"))
    each = {f"{name}|{band}": most for name in target for band in BAND_NAMES}
    leading = durable(cells.filter(first_rows(cells, order, each, "_cell")).drop("_cell"))
    picked: DataFrame | None = None
    for name, _ in sorted(mix, key=lambda item: sizes.get(item[0], 0)):
        free = leading.filter(F.col("intent") == name)
        if picked is not None:
            free = free.join(F.broadcast(picked.select(key)), key, "left_anti")  # at most ``total`` rows
        held = {r["band"]: r["n"] for r in free.groupBy("band").agg(F.count("*").alias("n")).collect()}
        bands = [b for b in BAND_NAMES if b in held]
        quota = dict(zip(bands, turns_taken([held[b] for b in bands], target[name])))
        turn = free.filter(first_rows(free, order, quota, "band"))
        picked = durable(turn if picked is None else picked.unionByName(turn))
    return picked.drop("_draw")


def population_weights(population: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per band: population size over sample size, the weight that undoes the sampling."""
    size = population.filter(F.col("band").isin(*BAND_NAMES)).groupBy("band").agg(F.count("*").alias("population"))
    taken = drawn.filter(F.col("band").isin(*BAND_NAMES)).groupBy("band").agg(F.count("*").alias("drawn"))
    return taken.join(size, "band").withColumn("sampling_weight", F.col("population") / F.col("drawn"))


def diversified_top_k(
    df: DataFrame, by: str, order: Sequence[Column], n: int, spread: Sequence[str], top_up: bool = True
) -> DataFrame:
    """The ``n`` leading rows, the best of every ``by`` value first, then (``top_up``) the next best overall."""
    best = last_rows(df, [by], order, n if top_up else 1, spread)
    return (
        best.withColumn("_again", (F.col("position") > 1).cast("int"))
        .orderBy("_again", *order)
        .limit(n)
        .drop("_again", "position")
    )

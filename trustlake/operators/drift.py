"""Population stability, null rates and the nightly drift check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake.config import SETTINGS
from trustlake.operators.calibration import halves
from trustlake.operators.joins import spread_join
from trustlake.operators.ranking import half_even, select_at, value_ranks


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (ids, feature, value) without NULL values."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(ids), list(features), "feature", "value").filter(F.col("value").isNotNull())


def quantile_edges(
    long: DataFrame, keys: Sequence[str], value: str = "value", bins: int = SETTINGS.bins, weight: Column | None = None
) -> DataFrame:
    """Per key the ``bins - 1`` order statistics that cut it, as array ``edges``.

    The i-th edge sits at position min(n-1, half-even(i*n/bins)). Values are
    counted before they are ordered (``weight`` as in ``value_ranks``); the
    array has at most ``bins - 1`` entries.
    """
    ranked = value_ranks(long, keys, value, weight)
    n = F.col("n_total")

    def position(i: Column) -> Column:
        return F.least(n - 1, half_even(i * n / F.lit(float(bins))))

    # a cheap necessary condition first: does i*n/bins fall near the row's positions for a whole i?
    first, last = F.col("before") - 1, F.col("before") + F.col("n")
    near = (F.floor(last * bins / n) >= F.ceil(first * bins / n)) | (last == n)
    here = F.filter(
        F.sequence(F.lit(1), F.lit(bins - 1)),
        lambda i: position(i).between(F.col("before"), F.col("before") + F.col("n") - 1),
    )
    cut = ranked.filter(near).select(*keys, value, F.explode(here).alias("_i"))
    return cut.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda e: e[value]).alias("edges")
    )


def bucket(value: Column, edges: Column, bins: int = SETTINGS.bins) -> Column:
    """Number of edges below the value, spelled out so that it stays in generated code."""
    below = [F.coalesce((F.get(edges, F.lit(i)) < value).cast("int"), F.lit(0)) for i in range(bins - 1)]
    return sum(below[1:], below[0])


def _psi(ref: list[Column], cur: list[Column]) -> Column:
    def share(part: Column, total: Column) -> Column:
        return F.greatest(part / total, F.lit(SETTINGS.psi_floor))

    n_ref, n_cur = sum(ref[1:], ref[0]), sum(cur[1:], cur[0])
    total = F.lit(0.0)
    for r, c in zip(ref, cur):
        total = total + (share(c, n_cur) - share(r, n_ref)) * F.ln(share(c, n_cur) / share(r, n_ref))
    return F.when((n_ref == 0) | (n_cur == 0), F.lit(0.0)).otherwise(total)


def psi_of(counts: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    ref = [F.col(f"_r{b}") for b in range(bins)]
    cur = [F.col(f"_c{b}") for b in range(bins)]
    return counts.select(
        *keys,
        sum(ref[1:], ref[0]).alias("n_ref"),
        sum(cur[1:], cur[0]).alias("n_cur"),
        _psi(ref, cur).alias("psi"),
    )


def selected_edges(long: DataFrame, key: str, value: str = "value", bins: int = SETTINGS.bins) -> dict[str, list[float]]:
    """The edges of ``quantile_edges`` for the few values of ``key``, selected without moving a row."""

    def positions(n: int, _) -> list[int]:
        return [min(n - 1, round(i * n / bins)) for i in range(1, bins)]

    return {k: [at[0] for at in edges] for k, (_, edges) in select_at(long, [value], positions, key).items()}


def psi(df: DataFrame, flag: str, features: Sequence[str], bins: int = SETTINGS.bins) -> DataFrame:
    """PSI per feature between the rows with ``flag`` 0 (reference) and 1 (current).

    The edges of the listed features are selected from the reference and become constants; one pass over the rows
    then counts every feature's buckets on both sides. An empty side gives 0.
    """
    long = unpivot(df, [flag], features)
    edges = selected_edges(long.filter(F.col(flag) == 0), "feature", bins=bins)
    constants = F.lit(None).cast("array<double>")
    for feature, values in edges.items():
        constants = F.when(F.col("feature") == feature, F.array(*[F.lit(float(v)) for v in values])).otherwise(constants)
    folded = long.groupBy("feature", bucket(F.col("value"), constants, bins).alias("_b")).agg(
        F.count(F.when(F.col(flag) == 0, 1)).alias("n_ref"), F.count(F.when(F.col(flag) == 1, 1)).alias("n_cur")
    )
    counts = [
        F.coalesce(F.sum(F.when(F.col("_b") == b, F.col(n))), F.lit(0)).alias(f"_{n[2]}{b}")
        for n in ("n_ref", "n_cur")
        for b in range(bins)
    ]
    return psi_of(folded.groupBy("feature").agg(*counts), ["feature"], bins)


def null_rates(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of NULLs per feature, all in one pass."""
    shares = [F.avg(F.col(f).isNull().cast("int")).alias(f) for f in features]
    return df.agg(*shares).unpivot([], list(features), "feature", "null_rate")


def unavailable_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Mean of every unavailability flag and whether it stays inside the envelope."""
    means = [F.avg(F.col(f).cast("double")).alias(f) for f in flags]
    rates = df.agg(*means).unpivot([], list(flags), "flag", "rate")
    return rates.withColumn("inside", F.coalesce(F.col("rate") < SETTINGS.null_envelope, F.lit(True)))


def distribution_stability(df: DataFrame, order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """PSI of the second half against the first, per feature with enough values on both sides."""
    needed = df.select(*order, *features)
    measured = psi(halves(needed, order), "half", features)
    enough = (F.col("n_ref") >= SETTINGS.stability_min_values) & (F.col("n_cur") >= SETTINGS.stability_min_values)
    return measured.filter(enough).withColumn("breach", F.col("psi") > SETTINGS.stability_psi_max)


def windowed_drift(
    decisions: DataFrame, value: str, keys: Sequence[str], reference_until_us: int, day_us: int,
    bins: int = SETTINGS.bins,
) -> DataFrame:
    """Per key and day: PSI of the day against the key's fixed reference period, with the sample floor.

    Days are tumbling windows on ``ts_us``. The reference is folded to one
    histogram per key, each day to another, so days never meet row by row. A key
    without reference rows keeps its days: no PSI, verdict ``insufficient_data``.
    """
    rows = decisions.select(*keys, "ts_us", F.col(value).cast("double").alias("value")).filter("value is not null")
    reference = rows.filter(F.col("ts_us") < reference_until_us)
    edges = quantile_edges(reference, keys, bins=bins)

    def folded(part: DataFrame, group: Sequence[str], name: str) -> DataFrame:
        joined = spread_join(part, edges, keys, spread="ts_us", how="left")
        slot = joined.withColumn("_b", bucket(F.col("value"), F.col("edges"), bins))
        return slot.groupBy(*group).agg(
            *[F.count(F.when(F.col("_b") == b, 1)).alias(f"_{name}{b}") for b in range(bins)]
        )

    current = rows.filter(F.col("ts_us") >= reference_until_us).withColumn(
        "day", F.floor(F.col("ts_us") / day_us).cast("bigint")
    )
    return against_reference(folded(current, [*keys, "day"], "c"), folded(reference, keys, "r"), keys, "day", bins)


def window_histograms(
    rows: DataFrame, value: str, keys: Sequence[str], edges: DataFrame, window: Column, name: str = "day", prefix: str = "c",
    bins: int = SETTINGS.bins,
) -> DataFrame:
    """Per key and window the counts (``_c0`` ..) on the key's fixed edges; histograms of any windows can be added up."""
    joined = spread_join(rows.withColumn(name, window), edges, keys, spread=value, how="left")
    slot = joined.withColumn("_b", bucket(F.col(value), F.col("edges"), bins))
    return slot.groupBy(*keys, name).agg(
        *[F.count(F.when(F.col("_b") == b, 1)).alias(f"_{prefix}{b}") for b in range(bins)]
    )


def _psi_arrays(ref: Column, cur: Column) -> Column:
    """PSI of two arrays of counts, null if one is missing or empty."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def term(r: Column, c: Column) -> Column:
        r, c = (F.greatest(x / total(whole), F.lit(SETTINGS.psi_floor)) for x, whole in ((r, ref), (c, cur)))
        return (c - r) * F.ln(c / r)

    value = F.aggregate(F.zip_with(ref, cur, term), F.lit(0.0), lambda a, x: a + x)
    return F.when((total(ref) > 0) & (total(cur) > 0), value)


def monitor(
    days: DataFrame, reference: DataFrame, keys: Sequence[str], window: str = "day", short: int = 7, bins: int = SETTINGS.bins
) -> DataFrame:
    """Each key's windows against three baselines, with a verdict, re-anchoring as it goes.

    ``days`` has a key's windows with their counts (``_c0`` ..), ``reference`` its fixed histogram (``_r0`` ..). ``psi_short``
    compares a window with the sum of the ``short`` windows of the key before it, ``psi_long`` with the reference,
    and ``psi_drift`` with the anchor: the reference at first, and from a window with verdict ``re_anchor`` on that window
    (``anchored``). A key without a reference has no verdict but ``insufficient_data``. The anchor makes each verdict depend on
    the ones before, so a key's windows, one short row each, are folded in order in one row; the decisions themselves are not.
    """
    counts = [f"_c{b}" for b in range(bins)]
    before = Window.partitionBy(*keys).orderBy(window).rowsBetween(-short, -1)
    rolled = days.select(
        *keys, window, F.array(*counts).alias("cur"), F.array(*[F.sum(c).over(before) for c in counts]).alias("past")
    )
    step = F.struct(F.col(window).alias("at"), "cur", F.when(F.get("past", F.lit(0)).isNotNull(), F.col("past")).alias("past"))
    lists = rolled.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    fixed = reference.select(*keys, F.array(*[F.col(f"_r{b}") for b in range(bins)]).alias("ref"))
    at_type = days.schema[window].dataType.simpleString()
    out_type = f"array<struct<at:{at_type},n:bigint,psi_short:double,psi_long:double,psi_drift:double,verdict:string,anchored:{at_type}>>"

    def fold(state: Column, now: Column) -> Column:
        n = F.aggregate(now["cur"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        psis = [_psi_arrays(base, now["cur"]) for base in (now["past"], F.col("ref"), state["anchor"])]
        verdict = F.when(F.col("ref").isNull(), "insufficient_data").otherwise(drift_verdict(n, *psis))
        row = F.struct(
            now["at"].alias("at"), n.alias("n"), *[p.alias(x) for p, x in zip(psis, ("psi_short", "psi_long", "psi_drift"))],
            verdict.alias("verdict"), state["anchored"].alias("anchored"),
        )
        moved = verdict == "re_anchor"
        return F.struct(
            F.when(moved, now["cur"]).otherwise(state["anchor"]).alias("anchor"),
            F.when(moved, now["at"]).otherwise(state["anchored"]).alias("anchored"),
            F.concat(state["out"], F.array(row)).cast(out_type).alias("out"),
        )

    start = F.struct(
        F.col("ref").alias("anchor"), F.lit(None).cast(at_type).alias("anchored"), F.array().cast(out_type).alias("out")
    )
    folded = lists.join(fixed, list(keys), "left").withColumn("_out", F.aggregate("steps", start, fold)["out"])
    return folded.select(*keys, F.explode("_out").alias("_r")).select(*keys, F.col("_r.at").alias(window), "_r.*").drop("at")


def against_reference(
    counts: DataFrame, reference: DataFrame, keys: Sequence[str], window: str, bins: int = SETTINGS.bins
) -> DataFrame:
    """PSI and verdict of each key's windows (counts ``_c0`` ..) against its reference (``_r0`` ..), which may be missing."""
    filled = counts.join(reference, list(keys), "left").fillna(0, [f"_r{b}" for b in range(bins)])
    known = F.col("n_ref") > 0
    measured = psi_of(filled, [*keys, window], bins).withColumn("psi", F.when(known, F.col("psi")))
    verdict = drift_verdict(F.col("n_cur"), F.col("psi"), F.lit(None), F.lit(None))
    return measured.withColumn("verdict", F.when(known, verdict).otherwise("insufficient_data"))


def drift_verdict(n: Column, psi_short: Column, psi_long: Column, psi_drift: Column) -> Column:
    """insufficient_data, L3, L2, L1, re_anchor or ok.

    Our own reading of the declared thresholds: a breach of the long baseline is
    the most serious, then that of the drift since the last anchor, then of the
    short window; with a short breach but a long baseline still close, re-anchor.
    """
    long_ok = F.coalesce(psi_long <= SETTINGS.reanchor_psi_long_max, F.lit(False))
    return (
        F.when(n < SETTINGS.drift_min_observations, "insufficient_data")
        .when(F.coalesce(psi_long > SETTINGS.psi_long, F.lit(False)), "L3")
        .when(F.coalesce(psi_drift > SETTINGS.psi_drift, F.lit(False)), "L2")
        .when((psi_short > SETTINGS.psi_short) & long_ok, "re_anchor")
        .when(psi_short > SETTINGS.psi_short, "L1")
        .otherwise("ok")
    )

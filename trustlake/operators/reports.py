"""Read-only reports over scored decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlake.config import ACTIONS, SETTINGS, band_table
from trustlake.functions import decision as dec
from trustlake.functions import ledger, pricing
from trustlake.functions import text as tx
from trustlake.operators.ranking import nearest_rank, order_statistics, upper_median

HELD = ("escalate", "close_call")


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def merge_one_row(first: DataFrame, second: DataFrame) -> DataFrame:
    """Put two one-row results with different columns side by side."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def release_summary(scored: DataFrame) -> DataFrame:
    """One row: what was released and what was held, in rows, money and outcome."""
    rows = scored.filter(F.col("region").isNotNull())
    released, held = F.col("region") == "act", F.col("region").isin(*HELD)
    refund = F.col("action") == "issue_refund"

    def money(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition & refund, F.round(F.col("amount") * 100).cast("bigint"))), F.lit(0))

    one = rows.agg(
        F.count("*").alias("scored"),
        _n(released).alias("released_n"),
        money(released).alias("released_paise"),
        _n(released & (F.col("outcome") == "clean")).alias("released_correct"),
        _n(released & refund).alias("released_actions"),
        _n(released & refund & (F.col("outcome") == "wrong")).alias("released_wrong_actions"),
        _n(held).alias("held_n"),
        money(held).alias("held_paise"),
        _n(held & refund).alias("held_actions"),
    )
    waiting = rows.filter(held).select(F.coalesce("p_wrong", F.lit(0.0)).alias("p"))
    median = order_statistics(waiting, [], "p", {"held_p_median": upper_median()}).select("held_p_median")
    return (
        merge_one_row(one, median)
        .withColumn("released_share", _share("released_n", "scored"))
        .withColumn("held_share", _share("held_n", "scored"))
    )


def band_panel(scored: DataFrame) -> DataFrame:
    """Per band: the refund record, the bar it has to clear and what was released; all bands are present."""
    refunds = scored.filter(F.col("action") == "issue_refund")
    counts = refunds.groupBy("band").agg(
        F.count("*").alias("n"),
        _n(F.col("outcome") == "clean").alias("clean"),
        _n(F.col("region") == "act").alias("released"),
        _n(F.col("region").isin(*HELD)).alias("held"),
    )
    bands = F.broadcast(band_table(scored.sparkSession, "issue_refund"))
    panel = pricing.with_action_terms(bands.join(counts, "band", "left"))
    n = F.coalesce("n", F.lit(0))
    any_row = F.col("n") > 0
    return (
        panel.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "clean", "released", "held")})
        .withColumn("rate", F.when(any_row, F.col("clean") / n))
        .withColumn("p_lo", F.when(any_row, ledger.wilson_lower(F.col("clean"), F.col("n"))))
        .withColumn("ceiling", pricing.ceiling(F.col("band")))
        .withColumn("budget", F.when(any_row, ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("n"))))
        .withColumn(
            "state",
            F.when(~any_row, "no decisions").when(F.col("budget") > 0, "autonomous").otherwise("supervised"),
        )
        .select("band", "n", "clean", "rate", "p_lo", "budget", "ceiling", "state", "released", "held")
    )


def run_summary(decisions: DataFrame) -> DataFrame:
    """One row about a run: verdict mix, acts per band, largest exposure acted on, median added latency."""
    acted = F.col("verdict") == "act"
    mix = decisions.groupBy("verdict", "band").agg(F.count("*").alias("_n"))  # verdicts x bands rows
    verdicts = mix.groupBy("verdict").agg(F.sum("_n").alias("_v"))
    bands = mix.filter(acted & F.col("band").isNotNull()).groupBy("band").agg(F.sum("_n").alias("_b"))

    def as_text(df: DataFrame, key: str, n: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.concat(F.col(key), F.lit("="), F.col(n).cast("string"))))
        return df.agg(F.array_join(entries, ", ").alias(name))

    one = decisions.agg(
        F.count("*").alias("n"),
        _n(acted).alias("acted"),
        F.coalesce(F.max(F.when(acted, F.col("exposure"))), F.lit(0.0)).alias("max_exposure"),
        (_n(F.coalesce("tier_reached", F.lit(1)) >= 2) / F.count("*")).alias("firing"),
    )
    added = decisions.select((F.coalesce("latency_ms", F.lit(0.0)) - F.coalesce("upstream_ms", F.lit(0.0))).alias("ms"))
    p50 = order_statistics(added, [], "ms", {"p50_added_ms": upper_median()}).select("p50_added_ms")
    out = merge_one_row(one, p50)
    out = merge_one_row(out, as_text(verdicts, "verdict", "_v", "verdicts"))
    return merge_one_row(out, as_text(bands, "band", "_b", "acted_by_band"))


def latency_summary(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles of the added latency, the deeper check's firing share and the four gates."""
    keys = list(keys)
    rows = decisions.select(*keys, (F.col("latency_ms") - F.col("upstream_ms")).alias("ms"), "tier_reached")
    tail = order_statistics(
        rows, keys, "ms", {"p50": nearest_rank(0.50), "p99": nearest_rank(0.99), "max_added": F.col("n_total") - 1}
    )
    fired = rows.groupBy(*keys).agg(F.count("*").alias("n"), (_n(F.col("tier_reached") >= 2) / F.count("*")).alias("firing"))
    joined = tail.join(fired, keys) if keys else merge_one_row(tail, fired)
    return joined.drop("n_total").withColumns(
        {
            "p50_ok": F.col("p50") < SETTINGS.latency_p50_max,
            "p99_ok": F.col("p99") < SETTINGS.latency_p99_max,
            "firing_ok": F.col("firing").between(SETTINGS.firing_min, SETTINGS.firing_max),
            "enough": F.col("n") >= SETTINGS.latency_min_requests,
        }
    )


def corpus_payload(scored: DataFrame) -> DataFrame:
    """One row of corpus totals with the three control routes, and the agent's model where it is recorded."""
    model = [F.min("agent_model").alias("model")] if "agent_model" in scored.columns else []
    return scored.agg(
        F.count("*").alias("turns"),
        F.count("region").alias("scored"),
        _n(F.col("outcome") == "wrong").alias("wrong"),
        _n(F.col("region") == "act").alias("release"),
        _n(F.col("region") == "close_call").alias("check_harder"),
        _n(F.col("region") == "escalate").alias("human_control"),
        *model,
    )


def explode_grid(df: DataFrame, **axes: Sequence[float]) -> DataFrame:
    """Every row once per point of a parameter grid, without a join."""
    out = df
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


ERROR_RATES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.20)  # fixed values: the swept error rates
SCALES = (0.5, 1.0, 1.5)


def cost_breakeven(
    decisions: DataFrame, error_rates: Sequence[float] = ERROR_RATES, scales: Sequence[float] = SCALES
) -> DataFrame:
    """Monthly cost per band, error rate and exposure scale: ship all, review all, or use the gate.

    Each band enters with its own mean amount and the record it has earned.
    """
    s = SETTINGS
    per_band = (
        decisions.filter(F.col("action") == "issue_refund")
        .groupBy("action", "band")
        .agg(F.avg("amount").alias("amount"), _n(F.col("outcome") == "clean").alias("n_clean"))
        .filter(pricing.band_max(F.col("band")).isNotNull())
    )
    grid = explode_grid(pricing.with_action_terms(per_band), error_rate=error_rates, scale=scales)
    volume, review = F.lit(float(s.monthly_volume)), F.lit(s.review_cost)
    loss = volume * F.col("error_rate") * F.col("exposure")
    priced = (
        grid.withColumn("ceiling", pricing.ceiling(F.col("band")) * F.col("scale"))
        .withColumn("exposure", pricing.exposure(F.col("amount")) * F.col("scale"))
        .withColumn("p_lo", ledger.wilson_lower(F.col("n_clean"), F.col("n_clean")))
        .withColumn("budget", ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("n_clean")))
        .withColumn(
            "verdict", dec.decide(F.col("error_rate"), F.col("exposure"), F.col("budget"), F.lit(False))
        )
        .withColumn("review_none", loss)
        .withColumn("review_all", volume * review)
    )
    gate = (
        F.when(F.col("verdict") == "act", loss)
        .when(F.col("verdict") == "check_harder", volume * F.lit(s.judge_call_cost) + 0.8 * loss + 0.2 * volume * review)
        .otherwise(volume * review)
    )
    return (
        priced.withColumn("with_layer", gate)
        .withColumn("saving_vs_all", F.col("review_all") - F.col("with_layer"))
        .withColumn("saving_vs_none", F.col("review_none") - F.col("with_layer"))
        .select(
            "band", "error_rate", "scale", "verdict", "exposure", "budget", "review_none", "review_all",
            "with_layer", "saving_vs_all", "saving_vs_none",
        )
    )


def recent_decisions(decisions: DataFrame, since_us: int = 0, verdict: str | None = None, limit: int = 100) -> DataFrame:
    """The newest decisions, at most 1000."""
    rows = decisions.filter(F.col("ts_us") >= since_us)
    if verdict:
        rows = rows.filter(F.col("verdict") == verdict)
    return rows.orderBy(F.desc("ts_us"), F.desc("id")).limit(min(limit, SETTINGS.decisions_page_max))


def extreme_per_region(scored: DataFrame) -> DataFrame:
    """One refund per region for display: the smallest act and close call, the largest escalation."""
    refunds = scored.filter(F.col("action") == "issue_refund")
    low = F.min(F.struct("amount", "id"))
    high = F.min(F.struct((-F.col("amount")).alias("amount"), F.col("id")))
    picked = refunds.groupBy("region").agg(low.alias("low"), high.alias("high"))
    escalated = F.col("region") == "escalate"
    # fixed values: route names and suggested modes
    route = (
        F.when(F.col("region") == "act", F.struct(F.lit("Autonomous release").alias("route"), F.lit("fast").alias("mode")))
        .when(escalated, F.struct(F.lit("Human control").alias("route"), F.lit("adaptive").alias("mode")))
        .otherwise(F.struct(F.lit("Deep verification").alias("route"), F.lit("deep").alias("mode")))
    )
    return picked.select(
        "region",
        F.when(escalated, F.col("high.id")).otherwise(F.col("low.id")).alias("id"),
        F.when(escalated, -F.col("high.amount")).otherwise(F.col("low.amount")).alias("amount"),
        route["route"].alias("route"),
        route["mode"].alias("suggested_mode"),
    )


# fixed values: route -> region, and whether large amounts come first
ROUTES = {"release": ("act", False), "check_harder": ("close_call", False), "human_control": ("escalate", True)}


def decision_routes(scored: DataFrame, by: str, length: str, n: int = 3) -> DataFrame:
    """(route, n, action_n, place, id, ``by``): the examples of each route, with the route's row counts.

    Refunds come first, then the smallest probability (of escalations: the largest
    amount), then the longest reply, then the id; of every ``by`` value only the first.
    """
    region = F.col("region")
    route = F.create_map(*[F.lit(x) for name, (of, _) in ROUTES.items() for x in (of, name)])[region]
    high = [of for of, first in ROUTES.values() if first]
    lead = F.when(region.isin(*high), -F.col("amount")).otherwise(F.coalesce("p_wrong", F.lit(0.0)))
    acting = F.col("action") == "issue_refund"
    rows = scored.filter(region.isin(*[of for of, _ in ROUTES.values()])).select(
        route.alias("route"), by, "id", acting.alias("_acting"),
        F.struct((~acting).alias("other"), lead.alias("lead"), (-F.coalesce(F.col(length), F.lit(0))).alias("shorter"), F.col("id")).alias("_order"),
    )
    first = rows.groupBy("route", by).agg(F.min("_order").alias("_order"), F.count("*").alias("_n"), F.count_if("_acting").alias("_a"))
    # one row a route and ``by`` value from here on
    route_rows = Window.partitionBy("route")
    ranked = first.withColumns({
        "n": F.sum("_n").over(route_rows), "action_n": F.sum("_a").over(route_rows),
        "place": F.row_number().over(route_rows.orderBy("_order")),
    })
    return ranked.filter(F.col("place") <= n).select("route", "n", "action_n", "place", F.col("_order.id").alias("id"), by)


def example_rows(turns: DataFrame) -> DataFrame:
    """One row a turn for display: what the customer and the agent said, the action, its price band and the outcome.

    An amount above the refund limit has no band; a turn without an amount counts as 0.
    """
    limit = next(row[9] for row in ACTIONS if row[0] == "issue_refund")
    amount = F.coalesce(F.col("action.amount_paise"), F.lit(0)) / 100.0
    return turns.select(
        "turn_id",
        "scenario",
        tx.quoted_after(F.coalesce("prompt", F.lit(""))).alias("customer"),
        tx.strip(F.coalesce("reply_text", F.lit(""))).alias("reply"),
        F.col("action.type").alias("action"),
        amount.alias("amount"),
        F.when(amount <= limit, pricing.band_of(amount)).alias("band"),
        "p_wrong",
        "region",
        "outcome",
        F.coalesce("outcome_reasons", F.array().cast("array<string>")).alias("reasons"),
    )


# fixed values: the expected criteria; the last two are asserted by tests, not measured by a job
CRITERIA = (
    (1, "Calibrated probability", None, "measured"),
    (2, "Autonomy earned, and revoked", None, "measured"),
    (3, "Latency bounded", None, "measured"),
    (4, "The layer pays for itself", None, "measured"),
    (5, "Reproducible by a stranger", True, "tests"),
    (6, "Fails closed", True, "tests"),
)


def criteria_status(reports: DataFrame) -> DataFrame:
    """Expected criteria with their recorded result; a missing one reads 'not run yet'."""
    spark = reports.sparkSession
    expected = spark.createDataFrame(
        list(CRITERIA), "criterion int, name string, asserted boolean, source string"
    )
    recorded = reports.select("criterion", "passed", "evidence")
    return (
        F.broadcast(expected)
        .join(recorded, "criterion", "left")
        .select(
            "criterion", "name", F.coalesce("passed", "asserted").alias("passed"), "source",
            F.coalesce("evidence", F.when(F.col("source") == "measured", F.lit("not run yet"))).alias("evidence"),
        )
    )


def registry_status(registry: DataFrame) -> DataFrame:
    """The registry row that became ready last."""
    newest = F.max_by(F.struct("version", "state", "runtime_version", "capability_tier", "ece_global"), F.col("ready_us"))
    return registry.agg(newest.alias("_r")).select("_r.*")


def judge_cost_estimate(turns: DataFrame, prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Tokens (four characters each plus a fixed part) and price of judging the turns."""
    s = SETTINGS
    chars = F.coalesce(F.length(prompt), F.lit(0)) + F.coalesce(F.length(reply), F.lit(0))
    return (
        turns.agg(F.count("*").alias("turns"), F.coalesce(F.sum(chars.cast("bigint")), F.lit(0)).alias("_c"))
        .withColumn("tokens_in", F.floor(F.col("_c") / 4) + F.col("turns") * 120)
        .withColumn("tokens_out", F.col("turns") * 110)
        .withColumn(
            "cost",
            F.col("tokens_in") / 1e6 * s.judge_in_per_mtok + F.col("tokens_out") / 1e6 * s.judge_out_per_mtok,
        )
        .drop("_c")
    )

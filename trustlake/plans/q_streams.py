"""Queries that run a stream over a given table to its end."""

from pyspark.sql import functions as F

from trustlake.operators import drift, models
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DAY
from trustlake.plans.q_calibration import SPLIT_AT, drift_sql, is_wrong
from trustlake.plans.q_gate import AS_OF, SECOND_DECISION, judgements, key_trust, second_model
from trustlake.plans.q_reports import registry
from trustlake.plans.q_trust import KEYS, accepted, reports
from trustlake.plans.registry import query
from trustlake.sources import model_store
from trustlake.streaming import decisions as live
from trustlake.streaming import outcomes as closing
from trustlake.streaming import runner, spans


def stream_table(spark, sf, name):
    """A given table as a stream of files."""
    return spark.readStream.schema(fx.TABLES[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_view(spark, sf, name):
    """A view over one table, with that table read as a stream."""
    return fx.VIEWS[name].spark(spark, sf, source=lambda t: stream_table(spark, sf, t))


#: Rows of a file of a batch, at least, where a batch has several files.
FILE_ROWS = 500_000


def in_batches(rows, time, n, folder, file_rows=FILE_ROWS):
    """Rows as a stream of ``n`` micro-batches in the order of ``time``, each of equally many files."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(time), F.max(time)).first()
    part = F.floor((F.col(time) - low) * n / (high - low + 1)) if low is not None else F.lit(0)
    sizes = rows.agg(*[F.count(F.when(part == i, 1)) for i in range(n)]).first()
    files = max(1, min(sizes) // file_rows)
    for i in range(n):
        here = rows.filter(part == i)
        # dealt out in turn, so no file is empty
        (here.coalesce(1) if files == 1 else here.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("stream_span_scores")
def stream_span_scores(spark, sf):
    chunks = spans.chunked(stream_table(spark, sf, "documents"), "doc_id", "text")
    out = runner.drain(spans.stream_spans(chunks), "spans")
    return spans.response_scores(out)


@query("stream_length_z", """
select id, length_z from ({inner}) s
""".replace("{inner}", f"""
select id, case when n < 30 then null when n*sq - s*s = 0 then 0::double
  else round((length - cast(s as double)/n) / sqrt(cast(n*sq - s*s as double) / (cast(n as double)*n)), 6) end as length_z
from (select id, length, count(*) {x.STRICT_BY_ACTION} as n, coalesce(sum(length) {x.STRICT_BY_ACTION}, 0) as s,
  coalesce(sum(cast(length as hugeint)*length) {x.STRICT_BY_ACTION}, 0) as sq from v_length) q"""))
def stream_length_z(spark, sf):
    folder = runner.work_folder(spark, "length")
    live.stream_length_z(stream_view(spark, sf, "v_length"), folder)
    return spark.read.parquet(f"{folder}/out").select("id", F.round("length_z", 6).alias("length_z"))


@query("stream_decide", """
select cast(id as bigint) as id, case when action='send_bulk_email' and amount > 50000 then 'over_limit' else band end as band,
  tier_reached, exposure, budget, verdict, region, rung, forced_review from v_final
""")
def stream_decide(spark, sf):
    folder = runner.work_folder(spark, "decide")
    requests = stream_view(spark, sf, "v_signal").drop("band", "outcome", "tier_reached").withColumnRenamed("p_wrong", "model_p")
    live.stream_decide(
        requests, folder,
        trust=lambda s: key_trust(s, sf),
        judgements=lambda s: judgements(s, sf),
        priors=lambda s: s.createDataFrame([("issue_refund", 0.05)], "action string, prior double"),
        registry=lambda s: registry(s, sf),
        running_version="rt-2",
        model_p=F.col("model_p"),
        load_model=lambda version: F.col("model_p"),
    )
    return spark.read.parquet(f"{folder}/decisions").select(
        "id", "band", "tier_reached", "exposure", "budget", "verdict", "region", "rung", "forced_review"
    )


@query("stream_second_decision", SECOND_DECISION)
def stream_second_decision(spark, sf):
    """The live gate with calibrator B."""
    folder = runner.work_folder(spark, "second")
    requests = stream_view(spark, sf, "v_signal").drop("band", "outcome", "tier_reached").withColumnRenamed("p_wrong", "model_p")
    live.stream_decide(
        requests, folder, trust=lambda s: key_trust(s, sf), judgements=lambda s: judgements(s, sf),
        priors=lambda s: s.createDataFrame([("issue_refund", 0.05)], "action string, prior double"),
        model_p=F.col("model_p"), model_b=second_model(),
    )
    rows = spark.read.parquet(f"{folder}/decisions")
    return rows.select("id", "tier_reached", F.round("p_wrong", 9).alias("p_wrong"), "region", "verdict")


@query("model_versions", """
select cast(id as bigint) as id, case when part = 0 then 'cal-v1' else 'cal-v2' end as calibrator_version, true as by_its_version,
  case when part = 2 then 'RefusedModel: other inputs' end as refused
from (select id, cast(floor((ts_us - min(ts_us) over ()) * 3 / (max(ts_us) over () - min(ts_us) over () + 1)) as integer) as part, policy_mode from v_signal) q
where policy_mode in ('fast', 'adaptive', 'deep')
""")
def model_versions(spark, sf):
    """Three batches, each after a new version was published: two score their batch, the broken third is refused."""
    folder = runner.work_folder(spark, "versions")
    view = fx.view(spark, sf, "v_signal")
    inputs = {"pii_score": F.coalesce("pii_score", F.lit(0.0)), "model_p": F.col("model_p") * 10}
    vector = view.withColumn("_x", F.array(F.coalesce("pii_score", F.lit(0.0)), F.col("p_wrong") * 10)).filter("outcome is not null")
    fitted = [models.fit_calibrator(vector.filter(F.col("id") % 2 == i), "_x", is_wrong()) for i in (0, 1)]
    for i, model in enumerate(fitted, 1):
        model_store.publish(spark, f"{folder}/models", f"cal-v{i}", model, list(inputs), "rt-2")
    model_store.publish(spark, f"{folder}/models", "cal-v3", fitted[0], list(inputs)[::-1], "rt-2")
    ready = []

    def registered(s):
        ready.append((f"cal-v{len(ready) + 1}", len(ready) + 1, "production", "none", "rt-2"))
        return s.createDataFrame(ready, "version string, ready_us bigint, state string, capability_tier string, runtime_version string")

    requests = view.drop("band", "outcome", "tier_reached").withColumnRenamed("p_wrong", "model_p")
    live.stream_decide(
        in_batches(requests, "ts_us", 3, f"{folder}/in"), folder, trust=lambda s: key_trust(s, sf),
        judgements=lambda s: judgements(s, sf).limit(0),
        priors=lambda s: s.createDataFrame([("issue_refund", 0.05)], "action string, prior double"),
        registry=registered, running_version="rt-2", load_model=model_store.scorer(spark, f"{folder}/models", inputs, "rt-2"),
    )
    used = F.lit(None).cast("double")
    for i, model in enumerate(fitted, 1):
        used = F.when(F.col("calibrator_version") == f"cal-v{i}", models.score_column(model, list(inputs.values()))).otherwise(used)
    asked = fx.view(spark, sf, "v_signal").select("id", "pii_score", F.col("p_wrong").alias("model_p"))
    rows = spark.read.parquet(f"{folder}/decisions").select("id", "calibrator_version", "p_wrong", "batch").join(asked, "id")
    swaps = spark.read.parquet(f"{folder}/swaps").select("batch", "refused")
    return rows.join(swaps, "batch", "left").select(
        "id", "calibrator_version", (F.abs(F.col("p_wrong") - used) < 1e-9).alias("by_its_version"), "refused"
    )


@query("stream_outcome_ingest", "select event_id, outcome, source, weight from v_accepted")
def stream_outcome_ingest(spark, sf):
    folder = runner.work_folder(spark, "ingest")
    rows = stream_view(spark, sf, "v_outcome_event")
    closing.stream_outcome_ingest(reports(spark, sf, rows), folder)
    return spark.read.parquet(f"{folder}/accepted").select("event_id", "outcome", "source", "weight")


@query("stream_close_outcomes", """
select decision_id, 'closed' as kind, arg_max(outcome, (weight, reported_us, event_id)) as outcome,
  arg_max(source, (weight, reported_us, event_id)) as outcome_source,
  arg_max(reported_us, (weight, reported_us, event_id)) as outcome_us, count(*) as events
from v_accepted where decision_id in (select id from v_decision) group by 1
""")
def stream_close_outcomes(spark, sf):
    events = accepted(spark, sf, stream_view(spark, sf, "v_outcome_event"))
    horizon = fx.view(spark, sf, "v_decision").select(F.col("id").alias("decision_id"), "horizon_us")
    out = closing.stream_close_outcomes(events.join(horizon, "decision_id"))
    return runner.drain(out, "close")


@query("stream_trust", f"""
select {KEYS}, round(n_total, 6) as n_total, round(budget, 6) as budget from v_trust
""")
def stream_trust(spark, sf):
    folder = runner.work_folder(spark, "trust")
    rows = in_batches(fx.view(spark, sf, "v_decision"), "ts_us", 4, f"{folder}/in")
    closing.stream_trust(rows, folder, AS_OF)
    from trustlake.sources.tables import read_snapshot

    return read_snapshot(spark, f"{folder}/trust").select(
        "agent_id", "action", "band", "fingerprint", F.round("n_total", 6).alias("n_total"), F.round("budget", 6).alias("budget")
    )


@query("stream_drift", f"""
select agent_id, day * {30 * DAY} as window_us, n_ref, n_cur, psi, verdict from ({drift_sql(30 * DAY)}) q
where (day + 1) * {30 * DAY} <= (select max(ts_us) from v_decision)
""")
def stream_drift(spark, sf):
    rows = fx.view(spark, sf, "v_decision").filter(F.col("ts_us") < SPLIT_AT).select("agent_id", F.col("p_wrong").alias("value"))
    edges = drift.quantile_edges(rows, ["agent_id"])
    slot = rows.join(edges, "agent_id").withColumn("_b", drift.bucket(F.col("value"), F.col("edges")))
    reference = slot.groupBy("agent_id").agg(*[F.count(F.when(F.col("_b") == b, 1)).alias(f"_r{b}") for b in range(10)])
    current = stream_view(spark, sf, "v_decision").filter(F.col("ts_us") >= SPLIT_AT)
    counts = closing.stream_drift_histogram(current, edges, ["agent_id"], "p_wrong", "0 seconds", "30 days")
    out = closing.drift_of_histogram(runner.drain(counts, "drift"), reference, ["agent_id"])
    return out.withColumn("psi", F.round("psi", 6))



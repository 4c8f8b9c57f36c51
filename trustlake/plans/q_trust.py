"""Queries over features, outcomes and trust."""

from pyspark.sql import functions as F

from trustlake.operators import features, outcomes, trust
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DUCK_VIEWS
from trustlake.plans.q_gate import AS_OF
from trustlake.plans.registry import query

HALF = 890_000_000_000_000  # 1998-03-16, in the middle of the decision history


@query("length_z", f"""
select id, case when n < 30 then null when n*sq - s*s = 0 then 0::double
  else round((length - cast(s as double)/n) / sqrt(cast(n*sq - s*s as double) / (cast(n as double)*n)), 6) end as length_z
from (select id, length, count(*) {x.STRICT_BY_ACTION} as n, coalesce(sum(length) {x.STRICT_BY_ACTION}, 0) as s,
  coalesce(sum(cast(length as hugeint)*length) {x.STRICT_BY_ACTION}, 0) as sq from v_length) q
""")
def length_z(spark, sf):
    out = features.length_z(fx.view(spark, sf, "v_length"), "action", "ts_us", "id", "length")
    return out.select("id", F.round("length_z", 6).alias("length_z"))


DUCK_VIEWS["v_judged"] = "select s.*, j.judge_p from v_signal s left join v_judge j on j.turn_id = s.id"


def assembled(spark, sf):
    judge = fx.view(spark, sf, "v_judge").select(F.col("turn_id").alias("id"), F.col("judge_p").alias("judge_p_wrong"))
    rows = (
        fx.view(spark, sf, "v_signal")
        .join(judge, "id", "left")
        .withColumn("verify_n_claims", F.when(F.col("id") % 71 != 0, F.col("id") % 5))
        .withColumn("hedge_density", (F.col("id") % 8) / 8)
        .withColumn("tool_retry_count", F.col("id") % 2)
        .withColumn("tool_error_count", F.lit(0))
        .withColumn("length_z_missing", F.when(F.col("id") % 2 == 0, "unavailable").otherwise("not_supported"))
        .withColumn("length_z", F.lit(1.5))
    )
    return features.assemble_features(
        rows, F.col("ts_us"), "none", not_supported=("logprob_mean", "logprob_min", "judge_p_wrong")
    )


FEATURE_SQL = """
select id, verify_fail_frac, case when verify_fail_frac is null then 1 else 0 end as verify_fail_frac_unavailable,
  case when id%71<>0 then cast(id%5 as double) end as verify_n_claims,
  cast(id%8 as double)/8 as hedge_density, cast(id%2 as double) as tool_retry_count,
  null::double as length_z, case when id%2=0 then 1 else 0 end as length_z_unavailable, null::double as logprob_mean,
  pii_score, case when pii_score is null then 1 else 0 end as pii_score_unavailable,
  null::double as policy_score, 1 as policy_score_unavailable, secret_score,
  judge_p as judge_p_wrong, 0 as judge_p_wrong_unavailable, ts_us as as_of
from v_judged"""


@query("assemble_features", FEATURE_SQL)
def assemble_features(spark, sf):
    return assembled(spark, sf).select("id", "features.*").select(
        "id", "verify_fail_frac", "verify_fail_frac_unavailable", "verify_n_claims", "hedge_density",
        "tool_retry_count", "length_z", "length_z_unavailable", "logprob_mean", "pii_score", "pii_score_unavailable",
        "policy_score", "policy_score_unavailable", "secret_score", "judge_p_wrong", "judge_p_wrong_unavailable", "as_of",
    )


@query("feature_vectors", """
select id, 22 as width, coalesce(verify_fail_frac, 0) as first_value,
  case when verify_fail_frac is null then 1::double else 0::double end as first_flag,
  coalesce(judge_p, 0) as judge_value, 0::double as judge_flag,
  secret_score from v_judged
""")
def feature_vectors(spark, sf):
    rows = assembled(spark, sf)
    fields = rows.schema["features"].dataType.fieldNames()
    names = features.model_features("none", with_judge=True)
    vector = rows.select("id", features.to_vector(F.col("features"), names, fields).alias("v"))
    at = {n: i + 1 for i, n in enumerate(features.vector_names(names))}
    return vector.select(
        "id",
        F.size("v").alias("width"),
        F.element_at("v", 1).alias("first_value"),
        F.element_at("v", 2).alias("first_flag"),
        F.element_at("v", at["judge_p_wrong"]).alias("judge_value"),
        F.element_at("v", at["judge_p_wrong_unavailable"]).alias("judge_flag"),
        F.element_at("v", at["secret_score"]).alias("secret_score"),
    )


def reports(spark, sf, rows=None):
    rows = fx.view(spark, sf, "v_outcome_event") if rows is None else rows
    return rows.select(
        "event_id", "decision_id", "reported_us", "processed_us",
        F.col("reported").alias("outcome"), F.col("event_source").alias("source"),
    )


def accepted(spark, sf, rows=None):
    return outcomes.accept_reports(reports(spark, sf, rows))[0]


VALID = "event_source <> 'rumour' and reported in ('clean','wrong')"
DUCK_VIEWS["v_accepted"] = f"""
select event_id, decision_id, reported_us, processed_us, reported as outcome, event_source as source,
  {x.source_weight('event_source')} as weight from v_outcome_event where {VALID}"""
DUCK_VIEWS["v_closed"] = f"""
select decision_id, outcome, source as outcome_source, reported_us as outcome_us from (
  select e.*, row_number() over (partition by e.decision_id order by weight desc, reported_us desc, event_id desc) as rn
  from v_accepted e join v_decision d on d.id = e.decision_id
  where e.processed_us is null and d.outcome is null and d.horizon_us <= {HALF}) w where rn = 1"""


@query("outcome_ingest", "select event_id, outcome, source, weight from v_accepted")
def outcome_ingest(spark, sf):
    return accepted(spark, sf).select("event_id", "outcome", "source", "weight")


@query("outcome_rejects", f"""
select event_id, case when event_source = 'rumour' then 'unregistered_source' else 'unregistered_outcome' end as reject_reason
from v_outcome_event where not ({VALID})
""")
def outcome_rejects(spark, sf):
    return outcomes.accept_reports(reports(spark, sf))[1].select("event_id", "reject_reason")


@query("due_decisions", f"select id, ts_us from v_decision where outcome is null and horizon_us <= {HALF}")
def due_decisions(spark, sf):
    return outcomes.due_decisions(fx.view(spark, sf, "v_decision"), HALF).select("id", "ts_us").orderBy("ts_us")


@query("open_events", f"""
select e.event_id, e.decision_id from v_accepted e join v_decision d on d.id = e.decision_id
where e.processed_us is null and d.outcome is null and d.horizon_us <= {HALF}
""")
def open_events(spark, sf):
    out = outcomes.open_events(accepted(spark, sf), fx.view(spark, sf, "v_decision"), HALF)
    return out.select("event_id", "decision_id")


def closed(spark, sf):
    return outcomes.resolve_outcomes(accepted(spark, sf), fx.view(spark, sf, "v_decision"), HALF)


@query("resolve_outcomes", "select * from v_closed")
def resolve_outcomes(spark, sf):
    return closed(spark, sf)


@query("close_decisions", """
select d.id, coalesce(d.outcome, c.outcome) as outcome,
  case when c.outcome is not null then c.outcome_source else d.source end as source
from v_decision d left join v_closed c on c.decision_id = d.id
""")
def close_decisions(spark, sf):
    out = outcomes.apply_outcomes(fx.view(spark, sf, "v_decision"), closed(spark, sf))
    return out.select("id", "outcome", "source")


@query("processed_events", f"""
select event_id, coalesce(processed_us, case when c.decision_id is not null then {HALF} end) as processed_us
from v_accepted e left join v_closed c using (decision_id)
""")
def processed_events(spark, sf):
    out = outcomes.mark_processed(accepted(spark, sf), closed(spark, sf), HALF)
    return out.select("event_id", "processed_us")


KEYS = "agent_id, action, band, fingerprint"
WEIGHT = x.evidence("source", "outcome_us", "ts_us", AS_OF)
DUCK_VIEWS["v_counts"] = f"""
select {KEYS}, sum(case when outcome='clean' then w else 0 end) as n_clean,
  sum(case when outcome in ('clean','wrong') then w else 0 end) as n_total,
  count(*) filter (where outcome in ('clean','wrong')) as n_own_raw, count(*) as n_decisions
from (select *, {WEIGHT} as w from v_decision) q group by all"""
DUCK_VIEWS["v_tail"] = f"""
select {KEYS}, count(*) filter (where from_end <= 100 and outcome='wrong') as failures,
  count(*) filter (where wrong_after = 0 and outcome='clean') as clean_run, count(*) as n_decisions
from (select *, row_number() over (partition by {KEYS} order by ts_us desc, id desc) as from_end,
  count(*) filter (where outcome='wrong') over (partition by {KEYS} order by ts_us, id
    rows between current row and unbounded following) as wrong_after from v_decision) q group by all"""


@query("weighted_counts", f"""
select {KEYS}, round(n_clean, 6) as n_clean, round(n_total, 6) as n_total, n_own_raw from v_counts
""")
def weighted_counts(spark, sf):
    out = trust.weighted_counts(fx.view(spark, sf, "v_decision"), AS_OF)
    return out.withColumn("n_clean", F.round("n_clean", 6)).withColumn("n_total", F.round("n_total", 6))


@query("recent_failures", """
select id, failures, failures >= 3 as trips from (
  select id, cast(sum(case when outcome='wrong' then 1 else 0 end) over (partition by agent_id, action, band
    order by ts_us, id rows between 99 preceding and current row) as bigint) as failures from v_decision) q
""")
def recent_failures(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select("id", "ts_us", "agent_id", "action", "band", "outcome")
    return trust.recent_failures(rows, ("agent_id", "action", "band")).select("id", "failures", "trips")


@query("breaker_state", f"""
select {KEYS}, failures, clean_run, case when prior is null and failures >= 3 then {AS_OF}
    when prior is not null and clean_run < 50 then prior end as tripped_at,
  cast(case when prior is not null and clean_run < 50 then clean_run else 0 end as bigint) as clean_since_trip
from (select *, case when fingerprint = 'fp_1' then {HALF} end as prior from v_tail) t
""")
def breaker_state(spark, sf):
    tail = trust.record_tail(fx.view(spark, sf, "v_decision"))
    prior = tail.filter("fingerprint = 'fp_1'").select(
        *trust.TRUST_KEYS, F.lit(HALF).alias("tripped_at"), F.lit(7).cast("bigint").alias("clean_since_trip")
    )
    return trust.breaker_state(tail, AS_OF, prior).drop("n_decisions")


P_LO = x.wilson_low("n_clean", "n_total")
DUCK_VIEWS["v_trust"] = f"""
select {KEYS}, n_total, n_clean, n_own_raw, p_lo, ceiling, tripped_at, case when tripped_at is not null then 0::double
  else coalesce({x.budget('p_lo', 'ceiling', 'n_own_raw')}, 0) end as budget
from (select c.*, {P_LO} as p_lo, {x.ceiling('action', 'band')} as ceiling,
    case when t.failures >= 3 then {AS_OF} end as tripped_at
  from v_counts c join v_tail t using ({KEYS}) where action in ('issue_refund','send_bulk_email')
    and band in ('0-2k','2k-10k','10k-50k','50k+')) q"""


@query("recompute_trust", f"""
select {KEYS}, round(n_total, 6) as n_total, n_own_raw, round(p_lo, 6) as p_lo, round(budget, 6) as budget, ceiling,
  case when budget > 0 then 'autonomous' else 'supervised' end as state, tripped_at from v_trust
""")
def recompute_trust(spark, sf):
    out = trust.recompute_trust(fx.view(spark, sf, "v_decision"), AS_OF)
    return out.select(
        *trust.TRUST_KEYS, F.round("n_total", 6).alias("n_total"), "n_own_raw", F.round("p_lo", 6).alias("p_lo"),
        F.round("budget", 6).alias("budget"), "ceiling", "state", "tripped_at",
    )


@query("borrow_strength", f"""
select c.{KEYS.replace(', ', ', c.')}, round(sum(o.n_clean * share), 6) as k_eff, round(sum(o.n_total * share), 6) as n_eff
from (select *, case band when '0-2k' then 0 when '2k-10k' then 1 when '10k-50k' then 2 else 3 end as i from v_counts
      where band in ('0-2k','2k-10k','10k-50k','50k+')) c
join (select *, case band when '0-2k' then 0 when '2k-10k' then 1 when '10k-50k' then 2 else 3 end as i from v_counts
      where band in ('0-2k','2k-10k','10k-50k','50k+')) o using (agent_id, action, fingerprint),
lateral (select case when o.i = c.i then 1::double else {x.d(0.1)} * pow({x.d(0.5)}, abs(o.i - c.i)) end as share) s
group by 1, 2, 3, 4
""")
def borrow_strength(spark, sf):
    counts = trust.weighted_counts(fx.view(spark, sf, "v_decision").filter("band not in ('unpriced','over_limit')"), AS_OF)
    out = trust.borrow_strength(counts)
    return out.select(*trust.TRUST_KEYS, F.round("k_eff", 6).alias("k_eff"), F.round("n_eff", 6).alias("n_eff"))


@query("upsert_trust", f"""
select {KEYS}, round(n_total, 6) as n_total, 'new' as origin from v_trust where fingerprint <> 'fp_0'
union all
select {KEYS}, 1::double, 'old' from v_trust where fingerprint = 'fp_0'
""")
def upsert_trust(spark, sf):
    now = trust.recompute_trust(fx.view(spark, sf, "v_decision"), AS_OF).select(
        *trust.TRUST_KEYS, F.round("n_total", 6).alias("n_total")
    )
    old = now.filter("fingerprint <> 'fp_2'").withColumn("n_total", F.lit(1.0)).withColumn("origin", F.lit("old"))
    new = now.filter("fingerprint <> 'fp_0'").withColumn("origin", F.lit("new"))
    return trust.upsert_trust(old, new)


@query("trust_report", f"""
select agent_id, action, band, round(n_clean, 6) as n_clean, round(n_total, 6) as n_total, n_own_raw,
  round(p_lo, 6) as p_lo, round(budget, 6) as budget, ceiling,
  case when budget > 0 then 'autonomous' else 'supervised' end as state
from v_trust where agent_id = 'agent_3' and action = 'issue_refund'
""")
def trust_report(spark, sf):
    rows = trust.recompute_trust(fx.view(spark, sf, "v_decision"), AS_OF)
    report = trust.trust_report(trust.trust_view(rows, "agent_3", "issue_refund"))
    return report.withColumns({c: F.round(c, 6) for c in ("n_clean", "n_total", "p_lo", "budget")})



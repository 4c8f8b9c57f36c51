"""Queries over proposed actions: price, budget, invariants, verdict, rung."""

from pyspark.sql import functions as F

from trustlake.config import OUTCOMES, SETTINGS, action_table
from trustlake.functions import decision as dec
from trustlake.functions import ledger, pricing
from trustlake.operators import gate, models
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DUCK_VIEWS
from trustlake.plans.registry import query

AS_OF = 1_000_000_000_000_000  # 2001-09-09, after the last decision of the test data

FAILED = """list_filter([case when pii_score is null or pii_score >= 0.5 then 'no_pii_egress' end,
  case when injection_score is null or injection_score >= 0.5 then 'no_prompt_injection' end,
  case when secret_score is null or secret_score >= 0.5 then 'no_secrets_in_output' end,
  case when retrieval_scope > user_scope then 'within_authorisation_scope' end,
  case when amount > hard_limit then 'within_hard_amount_limit' end], lambda x: x is not null)"""

DUCK_VIEWS["v_priced"] = f"""
select v.*, {x.exposure('action', 'amount')} as exposure, {x.ceiling('action', 'band')} as ceiling,
  {x.hard_limit('action')} as hard_limit from v_signal v"""
DUCK_VIEWS["v_checked"] = f"select *, {FAILED} as failed from v_priced"

HISTORY = "over (partition by agent_id, action, band order by ts_us, id rows between unbounded preceding and 1 preceding)"
DUCK_VIEWS["v_history"] = f"""
select *, count(*) filter (where outcome='clean') {HISTORY} as own_clean,
  count(*) filter (where outcome in ('clean','wrong')) {HISTORY} as own_total from v_checked"""
DUCK_VIEWS["v_earned"] = f"""
select *, coalesce({x.budget('p_lo', 'ceiling', 'own_total')}, {x.d(0)}) as budget
from (select *, {x.wilson_low('own_clean', 'own_total')} as p_lo from v_history) h"""
# the replay without sensors, and with them
DUCK_VIEWS["v_replay"] = f"""
select *, {x.region('verdict')} as region from (
  select *, {x.decide('p_wrong', 'exposure', 'budget', 'coalesce(amount > hard_limit, false)')} as verdict from v_earned) r"""
DUCK_VIEWS["v_replay_full"] = f"""
select *, {x.region('verdict')} as region from (
  select *, {x.decide('p_wrong', 'exposure', 'budget', 'len(failed) > 0')} as verdict from v_earned) r"""

# trust per key from all labels, unweighted
DUCK_VIEWS["v_key"] = f"""
select *, {x.budget('p_lo', 'ceiling', 'total')} as budget from (
  select *, {x.wilson_low('clean', 'total')} as p_lo, {x.ceiling('action', 'band')} as ceiling from (
    select agent_id, action, band, fingerprint, count(*) filter (where outcome='clean') as clean,
      count(*) filter (where outcome in ('clean','wrong')) as total
    from v_decision where action in ('issue_refund', 'send_bulk_email') and band<>'over_limit' group by all) a) b"""
DUCK_VIEWS["v_funded"] = f"""
select v.*, coalesce(k.budget, {x.d(0)}) as earned_budget from v_checked v
left join v_key k using (agent_id, action, band, fingerprint)"""
DUCK_VIEWS["v_policied"] = f"""
select *, earned_budget * budget_multiplier as budget from v_funded join (values
  ('fast', {x.d(1.25)}, 'disabled', {x.d(1)}), ('adaptive', {x.d(1)}, 'close_calls', {x.d(2)}),
  ('deep', {x.d(0.65)}, 'side_effects', {x.d(2)})) p(policy_mode, budget_multiplier, tier2_mode, policy_k) using (policy_mode)"""
DUCK_VIEWS["v_first"] = f"""
select *, {x.region('verdict')} as region from (
  select *, {x.decide('p_wrong', 'exposure', 'budget', 'len(failed) > 0', 'policy_k')} as verdict from v_policied) r"""
DUCK_VIEWS["v_second"] = f"""
select id, agent_id, action, band, amount, exposure, budget, region, verify_fail_frac, pii_score, secret_score, injection_score, localised,
  policy_mode, fires, case when fires then 2 else 1 end as tier_reached,
  case when fires then case when forced then 'deep_policy' else 'close_call' end end as tier2_trigger,
  case when fires and judge_p is not null then judge_p else p_wrong end as p_wrong,
  case when fires and judge_p is null then 'TIER2_TIMEOUT' end as degraded_reason,
  case when not fires then verdict when forced and judge_p is null then 'escalate'
    else {x.decide("case when judge_p is not null then judge_p else p_wrong end", 'exposure', 'budget', 'len(failed) > 0', '1')}
  end as verdict
from (select f.*, j.judge_p, tier2_mode <> 'disabled' and (verdict = 'check_harder' or forced) as fires
  from (select *, tier2_mode='side_effects' and action not in ('no_action','escalate')
          and coalesce(exposure > 40, false) and len(failed) = 0 as forced from v_first) f
  left join v_judge j on j.turn_id = f.id) g"""
HIT = f"(('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint < {int(SETTINGS.forced_review_rate * 2**32)})"
SEVERITY = f"(coalesce(p_wrong * exposure, 0) / greatest(budget, {x.d(1e-9)}))"
DUCK_VIEWS["v_final"] = f"""
select *, case verdict when 'block' then 6 when 'act' then 0 else
  case when coalesce(pii_score, 1) > 0.5 or coalesce(secret_score, 1) > 0.5 then case when localised then 2 else 5 end
    when coalesce(injection_score, 1) > 0.5 then 6
    when coalesce(verify_fail_frac, 1) > 0 then case when {SEVERITY} < 3 then 3 else 5 end
    when action not in ('no_action','escalate') then case when {SEVERITY} < 3 then 4 else 5 end
    else case when {SEVERITY} < 2 then 1 else 5 end end end as rung
from (select * exclude (verdict), verdict = 'act' and {HIT} as forced_review,
  case when verdict = 'act' and {HIT} then 'escalate' else verdict end as verdict from v_second) f"""


def decisions(spark, sf):
    return fx.view(spark, sf, "v_signal")


def checked(spark, sf):
    return gate.with_invariants(gate.price(decisions(spark, sf)))


def key_trust(spark, sf):
    """Unweighted trust per key from all labels; without a number of recipients an email earns no budget."""
    labelled = F.col("outcome").isin(*OUTCOMES)
    counts = (
        fx.view(spark, sf, "v_decision")
        .filter("action in ('issue_refund', 'send_bulk_email') and band <> 'over_limit'")
        .groupBy("agent_id", "action", "band", "fingerprint")
        .agg(F.count(F.when(F.col("outcome") == "clean", 1)).alias("clean"), F.count(F.when(labelled, 1)).alias("total"))
    )
    return (
        pricing.with_action_terms(counts)
        .withColumn("p_lo", ledger.wilson_lower(F.col("clean"), F.col("total")))
        .withColumn("ceiling", pricing.ceiling(F.col("band")))
        .withColumn("budget", ledger.budget(F.col("p_lo"), F.col("ceiling"), F.col("total")))
        .select("agent_id", "action", "band", "fingerprint", "clean", "total", "p_lo", "ceiling", "budget")
    )


def first_verdicts(spark, sf):
    known, _ = gate.apply_policy(gate.lookup_budget(checked(spark, sf), key_trust(spark, sf)))
    return gate.with_verdict(known, F.col("policy_k"))


def judgements(spark, sf):
    return fx.view(spark, sf, "v_judge").select(
        F.col("turn_id").alias("id"), "judge_p", F.lit(None).cast("string").alias("degraded_reason")
    )


def second_verdicts(spark, sf):
    return gate.resolve_tier2(first_verdicts(spark, sf), judgements(spark, sf))


@query("band_counts", """
select band, count(*) as n from (select case when amount < 2000 then '0-2k' when amount < 10000 then '2k-10k'
  when amount < 50000 then '10k-50k' when amount <= 200000 then '50k+' else 'over_limit' end as band
  from v_decision) b group by 1
""")
def band_counts(spark, sf):
    bands = fx.view(spark, sf, "v_decision").select(pricing.band_of(F.col("amount")).alias("band"))
    return bands.groupBy("band").agg(F.count("*").alias("n"))


@query("exposure_by_action", f"""
select action, count(*) as n, count(e) as priced, max(e) as max_exposure,
  cast(sum(cast(round(e * 100) as bigint)) as bigint) as exposure_paise
from (select action, {x.exposure('action', 'amount', 'id % 500')} as e from v_decision) q group by 1
""")
def exposure_by_action(spark, sf):
    payload = F.create_map(F.lit("recipient_count"), (F.col("id") % 500).cast("string"))
    priced = gate.price(fx.view(spark, sf, "v_decision"), payload=payload)
    return priced.groupBy("action").agg(
        F.count("*").alias("n"),
        F.count("exposure").alias("priced"),
        F.max("exposure").alias("max_exposure"),
        F.sum(F.round(F.col("exposure") * 100).cast("bigint")).alias("exposure_paise"),
    )


@query("ceiling_table", f"""
select action, band, max({x.ceiling('action', 'band', '10')}) as ceiling, count(*) as n from v_decision group by 1, 2
""")
def ceiling_table(spark, sf):
    priced = gate.price(fx.view(spark, sf, "v_decision"), payload=F.create_map(F.lit("recipient_count"), F.lit("10")))
    return priced.groupBy("action", "band").agg(F.max("ceiling").alias("ceiling"), F.count("*").alias("n"))


@query("hard_limit_breaches", f"""
select action, count(*) filter (where amount > {x.hard_limit('action')}) as over_limit, count(*) as n
from v_decision group by 1
""")
def hard_limit_breaches(spark, sf):
    priced = gate.price(fx.view(spark, sf, "v_decision"))
    return priced.groupBy("action").agg(
        F.count(F.when(F.col("amount") > F.col("hard_limit"), 1)).alias("over_limit"), F.count("*").alias("n")
    )


WILSON = x.wilson_parts("clean", "total")


@query("wilson_by_agent", f"""
select agent_id, clean, total, {WILSON[0]} as p_lo, {WILSON[1]} as p_hi from (
  select agent_id, count(*) filter (where outcome='clean') as clean,
    count(*) filter (where outcome in ('clean','wrong')) as total from v_decision group by 1) a
""")
def wilson_by_agent(spark, sf):
    counts = (
        fx.view(spark, sf, "v_decision")
        .groupBy("agent_id")
        .agg(F.count(F.when(F.col("outcome") == "clean", 1)).alias("clean"), F.count("outcome").alias("total"))
    )
    low, high = ledger.wilson(F.col("clean"), F.col("total"))
    return counts.withColumn("p_lo", low).withColumn("p_hi", high)


@query("budget_by_key", "select * from v_key")
def budget_by_key(spark, sf):
    return key_trust(spark, sf)


@query("evidence_weights", f"""
select id, round({x.evidence('source', 'outcome_us', 'ts_us', AS_OF)}, 9) as weight from v_decision
""")
def evidence_weights(spark, sf):
    weight = ledger.evidence_age_weight(F.col("source"), F.col("outcome_us"), F.col("ts_us"), AS_OF)
    return fx.view(spark, sf, "v_decision").select("id", F.round(weight, 9).alias("weight"))


@query("fingerprints", """
select id, substr(sha256('{"calibrator":"cal-v' || (id%3) || '","model":"' || agent_id || '","prompt":"'
  || sha256('You are agent ' || (id%5)) || '","sensors":"sv-1","tools":[{"name":"lookup"},{"name":"refund_'
  || (id%2) || '"}]}'), 1, 16) as config_fingerprint from v_decision
""")
def fingerprints(spark, sf):
    def tool(name):
        return F.struct(name.alias("name"), F.concat(F.lit('{"name":"'), name, F.lit('"}')).alias("json"))

    ident = F.col("id")
    tools = F.array(tool(F.concat(F.lit("refund_"), (ident % 2).cast("string"))), tool(F.lit("lookup")))
    return fx.view(spark, sf, "v_decision").select(
        "id",
        ledger.fingerprint(
            F.col("agent_id"),
            F.concat(F.lit("You are agent "), (ident % 5).cast("string")),
            tools,
            F.lit("sv-1"),
            F.concat(F.lit("cal-v"), (ident % 3).cast("string")),
        ).alias("config_fingerprint"),
    )


@query("sensor_versions", """
select sensor_version, count(*) as n from (
  select 'sv-' || substr(sha256('{"tier0":"t0-v' || (id%2) || '","tier1":"t1-v1","tier2_model":"judge-'
    || (id%3) || '","tier2_thinking":"disabled"}'), 1, 12) as sensor_version from v_decision) q group by 1
""")
def sensor_versions(spark, sf):
    ident = F.col("id")
    label = ledger.sensor_version_column(
        F.concat(F.lit("t0-v"), (ident % 2).cast("string")),
        F.lit("t1-v1"),
        F.concat(F.lit("judge-"), (ident % 3).cast("string")),
        F.lit("disabled"),
    )
    return (
        fx.view(spark, sf, "v_decision").groupBy(label.alias("sensor_version")).agg(F.count("*").alias("n"))
    )


@query("invariants", """
select id, array_to_string(failed, ',') as failed, len(failed) > 0 as violated from v_checked
""")
def invariants(spark, sf):
    return checked(spark, sf).select("id", F.array_join("failed", ",").alias("failed"), "violated")


@query("lookup_budget", "select id, earned_budget from v_funded")
def lookup_budget(spark, sf):
    return gate.lookup_budget(decisions(spark, sf), key_trust(spark, sf)).select("id", "earned_budget")


@query("reject_unpriced", """
select id, case when id%23=0 then 'wire_money' else action end as action from v_decision
where id%23=0
""")
def reject_unpriced(spark, sf):
    odd = fx.view(spark, sf, "v_decision").withColumn(
        "action", F.when(F.col("id") % 23 == 0, "wire_money").otherwise(F.col("action"))
    )
    _, rejected = gate.reject_unpriced(odd.select("id", "action"), action_table(spark))
    return rejected.select("id", "action")


@query("decide_verdicts", f"""
select action, band, verdict, count(*) as n from (
  select action, band, {x.decide('p_wrong', 'exposure', 'earned_budget', 'len(failed) > 0')} as verdict
  from v_funded) q group by all
""")
def decide_verdicts(spark, sf):
    funded = gate.lookup_budget(checked(spark, sf), key_trust(spark, sf)).withColumnRenamed("earned_budget", "budget")
    return gate.with_verdict(funded).groupBy("action", "band", "verdict").agg(F.count("*").alias("n"))


@query("region_counts", "select region, verdict, count(*) as n from v_replay_full group by all")
def region_counts(spark, sf):
    return replayed(spark, sf, signals=True).groupBy("region", "verdict").agg(F.count("*").alias("n"))


@query("policy_overlay", """
select policy_mode, verdict, region, count(*) as n, max(budget) as max_budget from v_first group by all
""")
def policy_overlay(spark, sf):
    return first_verdicts(spark, sf).groupBy("policy_mode", "verdict", "region").agg(
        F.count("*").alias("n"), F.max("budget").alias("max_budget")
    )


@query("policy_rejects", "select id, policy_mode from v_decision where policy_mode not in ('fast','adaptive','deep')")
def policy_rejects(spark, sf):
    funded = fx.view(spark, sf, "v_decision").withColumn("earned_budget", F.lit(0.0))
    return gate.apply_policy(funded)[1].select("id", "policy_mode")


@query("tier2_resolution", """
select id, verdict, region, tier_reached, tier2_trigger, degraded_reason, p_wrong from v_second
""")
def tier2_resolution(spark, sf):
    return second_verdicts(spark, sf).select(
        "id", "verdict", "region", "tier_reached", "tier2_trigger", "degraded_reason", "p_wrong"
    )


#: A second calibrator in plain numbers: weights of the two log odds and of their gap, and the intercept.
SECOND = (0.7, 0.6, 0.1, -0.4)
SECOND_SQL = "1 / (1 + exp(-({w[0]} * {p} + {w[1]} * {j} + {w[2]} * abs({p} - {j}) + {w[3]})))".format(
    w=[x.d(w) for w in SECOND], p="logit_p", j="logit_j"
)
LOGIT = f"ln(greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, {{0}})) / (1 - greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, {{0}}))))"
DUCK_VIEWS["v_second_b"] = f"""
select id, band, exposure, budget, region, tier_reached, policy_mode, second_p as p_wrong, amount, action,
  case when not fires then verdict when forced and judge_p is null then 'escalate'
    else {x.decide("second_p", "exposure", "budget", "len(failed) > 0", "1")} end as verdict
from (select * exclude (tier_reached), case when fires then 2 else 1 end as tier_reached, case when fires and judge_p is not null then {SECOND_SQL} else p_wrong end as second_p
  from (select f.*, j.judge_p, tier2_mode <> 'disabled' and (verdict = 'check_harder' or forced) as fires,
      {LOGIT.format("p_wrong")} as logit_p, {LOGIT.format("j.judge_p")} as logit_j
    from (select *, tier2_mode='side_effects' and action not in ('no_action','escalate')
            and coalesce(exposure > 40, false) and len(failed) = 0 as forced from v_first) f
    left join v_judge j on j.turn_id = f.id) g) h"""
SECOND_DECISION = f"""
select cast(id as bigint) as id, tier_reached, round(p_wrong, 9) as p_wrong, region,
  case when verdict = 'act' and {HIT} then 'escalate' else verdict end as verdict from v_second_b"""


def second_model():
    """The plain second calibrator as the column that the gate takes."""
    inputs = models.stacked_inputs(F.col("p_wrong"), F.col("judge_p"))
    margin = F.lit(SECOND[3])
    for weight, value in zip(SECOND, inputs.values()):
        margin = margin + F.lit(weight) * value
    return F.when(F.col("judge_p").isNotNull(), 1 / (1 + F.exp(-margin)))


@query("second_decision", SECOND_DECISION)
def second_decision(spark, sf):
    """After the deeper check calibrator B decides, not the judge's own number."""
    requests = decisions(spark, sf).drop("band", "outcome", "tier_reached").withColumnRenamed("p_wrong", "model_p")
    priors = spark.createDataFrame([("issue_refund", 0.05)], "action string, prior double")
    rows, _ = gate.decide_batch(
        requests, key_trust(spark, sf), judgements(spark, sf), priors, model_p=F.col("model_p"), model_b=second_model()
    )
    return rows.select("id", "tier_reached", F.round("p_wrong", 9).alias("p_wrong"), "region", "verdict")


@query("forced_review", f"""
select id, case when verdict='act' and {HIT} then 'escalate' else verdict end as verdict, region,
  verdict='act' and {HIT} as forced_review from v_first
""")
def forced_review(spark, sf):
    return gate.forced_review(first_verdicts(spark, sf)).select("id", "verdict", "region", "forced_review")


@query("rungs", """
select rung, case rung when 4 then '~15 s' when 5 then 'minutes' else 'none' end as human_time, verdict, count(*) as n
from v_final group by all
""")
def rungs(spark, sf):
    rows = gate.with_rung(gate.forced_review(second_verdicts(spark, sf)))
    return (
        rows.withColumn("human_time", dec.human_time(F.col("rung")))
        .groupBy("rung", "human_time", "verdict")
        .agg(F.count("*").alias("n"))
    )


@query("regenerate_next", """
select next_rung, count(*) as n from (
  select case when count(*) < 2 then 3 else 5 end as next_rung from events where event_type='error' group by user_id) q
group by 1
""")
def regenerate_next(spark, sf):
    attempts = (
        fx.table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    )
    return (
        attempts.select(dec.regenerate_next(F.col("attempts")).alias("next_rung"))
        .groupBy("next_rung")
        .agg(F.count("*").alias("n"))
    )


@query("p_wrong_sources", f"""
select id, coalesce(case when id%3=0 then p_wrong end, case when id%3=1 then {x.d(0.031)} end,
  case when action='issue_refund' then {x.d(0.07)} end, {x.d(0.05)}) as p_wrong from v_decision
""")
def p_wrong_sources(spark, sf):
    priors = spark.createDataFrame([("issue_refund", 0.07)], "action string, prior double")
    rows = fx.view(spark, sf, "v_decision").withColumnRenamed("p_wrong", "p")
    ident = F.col("id") % 3
    out = gate.p_wrong_or_prior(rows, F.when(ident == 0, F.col("p")), F.when(ident == 1, F.lit(0.031)), priors)
    return out.select("id", "p_wrong")


LOGIT = f"ln(greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, p_wrong)) / (1 - greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, p_wrong))))"


@query("platt_apply", f"select id, round(1/(1+exp(-({x.d(0.8)}*{LOGIT}+{x.d(-0.3)}))), 9) as p from v_decision")
def platt_apply(spark, sf):
    return fx.view(spark, sf, "v_decision").select("id", F.round(ledger.platt(F.col("p_wrong"), 0.8, -0.3), 9).alias("p"))


@query("decision_reasons", """
select id, case when verdict='act' and exposure <= 40 then 'action exposure is below the cost of human review'
  when verdict='act' then printf('expected loss %.2f is within earned budget %.2f for ', p_wrong*exposure, budget) || action || ' in ' || band
  when verdict='check_harder' then printf('expected loss %.2f is close enough to earned budget %.2f for deeper verification', p_wrong*exposure, budget)
  when verdict='block' then 'a fixed safety invariant failed; earned trust cannot override it'
  else printf('expected loss %.2f exceeds earned budget %.2f; human control is retained', p_wrong*exposure, budget) end as reason
from v_first
""")
def decision_reasons(spark, sf):
    reason = dec.decision_reason(
        F.col("verdict"), F.col("action"), F.col("band"), F.col("p_wrong"), F.col("exposure"), F.col("budget")
    )
    return first_verdicts(spark, sf).select("id", reason.alias("reason"))


@query("added_latency", """
select tier_reached, count(*) as n, min(latency_ms - upstream_ms) as min_added, max(latency_ms - upstream_ms) as max_added
from v_decision group by 1
""")
def added_latency(spark, sf):
    added = F.col("latency_ms") - F.col("upstream_ms")
    return fx.view(spark, sf, "v_decision").groupBy("tier_reached").agg(
        F.count("*").alias("n"), F.min(added).alias("min_added"), F.max(added).alias("max_added")
    )


NEEDED = ("id", "ts_us", "agent_id", "action", "band", "amount", "p_wrong", "outcome")


def replayed(spark, sf, signals=False, where=None, extra=()):
    rows = decisions(spark, sf) if signals else fx.view(spark, sf, "v_decision")
    if where is not None:
        rows = rows.filter(where)
    scores = ("pii_score", "injection_score", "secret_score", "retrieval_scope", "user_scope") if signals else ()
    return gate.replay_gate(rows.select(*NEEDED, *scores, *extra), signals=signals)


@query("replay_gate", """
select band, verdict, count(*) as n from v_replay group by all
""")
def replay_gate(spark, sf):
    rows = replayed(spark, sf)
    return rows.groupBy("band", "verdict").agg(F.count("*").alias("n"))


@query("replay_rows", "select id, own_clean, own_total, budget, verdict, region from v_replay_full")
def replay_rows(spark, sf):
    return replayed(spark, sf, signals=True).select("id", "own_clean", "own_total", "budget", "verdict", "region")


@query("decide_batch", f"""
select id, case when action='send_bulk_email' and amount > 50000 then 'over_limit' else band end as band,
  tier_reached, tier2_trigger, p_wrong, exposure, budget, verdict, region, rung, forced_review,
  degraded_reason is not null as degraded_mode from v_final
""")
def decide_batch(spark, sf):
    requests = decisions(spark, sf).drop("band", "outcome", "tier_reached")
    requests = requests.withColumnRenamed("p_wrong", "model_p")
    priors = spark.createDataFrame([("issue_refund", 0.05)], "action string, prior double")
    rows, _ = gate.decide_batch(
        requests, key_trust(spark, sf), judgements(spark, sf), priors, model_p=F.col("model_p")
    )
    return rows.select(
        "id", "band", "tier_reached", "tier2_trigger", "p_wrong", "exposure", "budget", "verdict", "region",
        "rung", "forced_review", "degraded_mode",
    )

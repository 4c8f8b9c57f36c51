"""Queries: corpus validation, governance, sampling and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trustlake.config import BAND_NAMES, FEATURE_NAMES, INTENT_MIX
from trustlake.functions import pricing
from trustlake.operators import calibration as cal
from trustlake.operators import drift, gate, governance, record, reports, sampling, validation
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DAY, DUCK_VIEWS
from trustlake.plans.q_calibration import ORDER, checked_answers, feature_rows, is_wrong, judged_pairs, region_report
from trustlake.plans.q_gate import AS_OF, checked, key_trust, replayed
from trustlake.plans.q_record import pools
from trustlake.plans.q_trust import assembled
from trustlake.plans.registry import query
from trustlake.sources import tables
from trustlake.streaming import runner

# --- corpus validation ------------------------------------------------------------


def check_labels(spark, sf):
    return validation.label_balance(fx.view(spark, sf, "v_decision"))


def check_bands(spark, sf):
    return validation.band_coverage(fx.view(spark, sf, "v_decision"), "amount", 200000.0)


def check_regions(spark, sf):
    return validation.region_coverage(replayed(spark, sf))


def check_nulls(spark, sf):
    rows = fx.view(spark, sf, "v_signal").select(
        F.col("pii_score").isNull().cast("int").alias("pii_score_unavailable"),
        (F.col("id") % 9 == 0).cast("int").alias("length_z_unavailable"),
    )
    return validation.null_semantics(drift.unavailable_rates(rows, rows.columns))


def check_stability(spark, sf):
    rows = feature_rows(spark, sf)
    measured = drift.distribution_stability(rows, ORDER, ("quantity", "price", "discount", "tax"))
    return validation.distribution_stability(measured, rows)


def check_judge(spark, sf):
    pairs = judged_pairs(spark, sf)
    return validation.judge_calibration(
        cal.spearman(pairs, [], "judge_p", "y"), cal.distinct_deciles(pairs, [], "judge_p")
    )


def check_schema(spark, sf):
    return validation.judge_schema(checked_answers(spark, sf), "seq", F.col("degraded_reason").isNotNull())


def check_mode(spark, sf):
    return validation.judge_mode(fx.view(spark, sf, "v_judge"))


def stored_features(spark, sf, swapped=False):
    """Assembled features as a cache file has them; ``swapped`` writes two of them in each other's place."""
    path = f"{runner.work_folder(spark, 'features')}"
    rows = assembled(spark, sf).select(F.col("id").alias("turn_id"), "features")
    if swapped:
        names = rows.schema["features"].dataType.fieldNames()
        first, second = (names.index(n) for n in FEATURE_NAMES[:2])
        names[first], names[second] = names[second], names[first]
        rows = rows.withColumn("features", F.struct(*[F.col("features")[n].alias(n) for n in names]))
    tables.write_feature_cache(rows, path)
    return spark.read.parquet(path)


def check_order(spark, sf):
    return validation.feature_order(validation.stored_order(stored_features(spark, sf)))


DUCK_VIEWS["v_check_labels"] = """
select 'label-balance' as "check", case when n = 0 then 'SKIP' when cast(w as double)/n between 0.03 and 0.25 then 'PASS' else 'FAIL' end as status,
  w || ' wrong of ' || n as detail from (select count(*) filter (where outcome='wrong') as w,
  count(*) filter (where outcome in ('clean','wrong')) as n from v_decision) q"""
DUCK_VIEWS["v_check_bands"] = """
select 'band-coverage' as "check", case when least(a, b, c, d) >= 150 then 'PASS' else 'FAIL' end as status,
  '0-2k=' || a || ', 2k-10k=' || b || ', 10k-50k=' || c || ', 50k+=' || d as detail from (
  select count(*) filter (where amount < 2000) as a, count(*) filter (where amount >= 2000 and amount < 10000) as b,
    count(*) filter (where amount >= 10000 and amount < 50000) as c,
    count(*) filter (where amount >= 50000 and amount <= 200000) as d from v_decision) q"""
DUCK_VIEWS["v_check_regions"] = """
select 'region-coverage' as "check", case when n >= 100 then 'PASS' else 'FAIL' end as status, n || ' close_call turns' as detail
from (select count(*) filter (where region='close_call') as n from v_replay) q"""
DUCK_VIEWS["v_check_nulls"] = """
select 'null-semantics' as "check", case when len(bad) = 0 then 'PASS' else 'FAIL' end as status,
  case when len(bad) = 0 then 'every feature inside its envelope' else 'outside: ' || array_to_string(bad, ', ') end as detail
from (select list_filter([case when avg((id%9=0)::int) >= 0.05 then 'length_z_unavailable' end,
  case when avg((pii_score is null)::int) >= 0.05 then 'pii_score_unavailable' end], lambda b: b is not null) as bad from v_signal) q"""
DUCK_VIEWS["v_check_stability"] = """
select 'distribution-stability' as "check", case when n < 200 then 'SKIP' when bad is null then 'PASS' else 'FAIL' end as status,
  case when bad is null then 'all features stable across the halves' else 'moved: ' || bad end as detail
from (select (select count(*) from v_feature) as n, string_agg(feature, ', ' order by feature) filter (where psi > 0.1) as bad from v_psi) q"""
DUCK_VIEWS["v_check_judge"] = """
select 'judge-calibration' as "check", case when n < 50 then 'SKIP' when rho >= 0.3 and d >= 3 then 'PASS' else 'FAIL' end as status,
  printf('rho=%.3f over ', rho) || n || ' rows, spans ' || d || ' deciles' as detail from (
  select count(*) as n, corr(rx, ry) as rho, count(distinct least(9, floor(judge_p*10))) as d from (
    select judge_p, rank() over (order by judge_p) + (count(*) over (partition by judge_p) - 1)/2.0::double as rx,
      rank() over (order by y) + (count(*) over (partition by y) - 1)/2.0::double as ry from v_pairs) r) q"""
DUCK_VIEWS["v_check_schema"] = """
select 'judge-schema' as "check", case when v <= 1 then 'PASS' else 'FAIL' end as status, v || ' violation(s) in ' || n || ' calls' as detail
from (select count(*) as n, count(*) filter (where not good) as v from (select good from v_judge_checked order by seq limit 50) s) q"""
DUCK_VIEWS["v_check_mode"] = """
select 'judge-mode' as "check", case when n = 1 then 'PASS' else 'FAIL' end as status, n || ' judge configuration(s)' as detail
from (select count(distinct (model, thinking)) as n from v_judge) q"""
DUCK_VIEWS["v_check_order"] = """
select 'feature-order' as "check", case when count(*) > 0 then 'PASS' else 'SKIP' end as status, '15 features' as detail from v_decision"""

CHECKS = {
    "label_balance": (check_labels, "v_check_labels"),
    "band_coverage": (check_bands, "v_check_bands"),
    "region_coverage": (check_regions, "v_check_regions"),
    "null_semantics": (check_nulls, "v_check_nulls"),
    "stability_check": (check_stability, "v_check_stability"),
    "judge_calibration": (check_judge, "v_check_judge"),
    "judge_schema": (check_schema, "v_check_schema"),
    "judge_mode": (check_mode, "v_check_mode"),
    "feature_order": (check_order, "v_check_order"),
}
for _name, (_check, _view) in CHECKS.items():
    query(_name, f"select * from {_view}")(_check)

ALL_CHECKS = "\nunion all\n".join(f"select * from {view}" for _, view in CHECKS.values())


@query("feature_order_swapped", """select 'feature-order' as "check", 'FAIL' as status, '15 features' as detail""")
def feature_order_swapped(spark, sf):
    """Features that were stored in another order are found."""
    return validation.feature_order(validation.stored_order(stored_features(spark, sf, swapped=True)))


@query("validation_gate", ALL_CHECKS)
def validation_gate(spark, sf):
    return validation.validation_gate([check(spark, sf) for check, _ in CHECKS.values()])


# --- registry and governance ------------------------------------------------------

DUCK_VIEWS["v_registry"] = f"""
select version, created_us + {DAY} as ready_us, case when n = last then 'candidate' when n = last - 1 then 'production'
    when n % 2 = 0 then 'retired' else 'production' end as state, case when n % 3 = 0 then 'topk' else 'none' end as capability_tier,
  case when n = 2 then 'rt-1' else 'rt-2' end as runtime_version, ece_global, ece_close_call, n_global, n_close_call
from (select *, cast(substr(version, 6) as integer) as n, max(cast(substr(version, 6) as integer)) over () as last from (
  select calibrator_version as version, min(v.ts_us) as created_us,
    round(abs(avg(p_wrong) - avg(y)), 9) as ece_global, round(abs(avg(p_wrong) filter (where id%2=0) - avg(y) filter (where id%2=0)), 9) as ece_close_call,
    count(*) as n_global, count(*) filter (where id%2=0) as n_close_call
  from v_version v join (select id, p_wrong, case when outcome='wrong' then 1 else 0 end as y from v_decision) d using (id)
  group by 1) a) b"""


def registry(spark, sf):
    """One registry row per calibrator version, measured on the decisions of its year."""
    y = F.when(is_wrong(), 1).otherwise(0)
    rows = fx.view(spark, sf, "v_version").select("id", "ts_us", "calibrator_version").join(
        fx.view(spark, sf, "v_decision").select("id", "p_wrong", y.alias("y")), "id"
    )
    even = F.col("id") % 2 == 0
    per = rows.groupBy(F.col("calibrator_version").alias("version")).agg(
        F.min("ts_us").alias("created_us"),
        F.round(F.abs(F.avg("p_wrong") - F.avg("y")), 9).alias("ece_global"),
        F.round(F.abs(F.avg(F.when(even, F.col("p_wrong"))) - F.avg(F.when(even, F.col("y")))), 9).alias("ece_close_call"),
        F.count("*").alias("n_global"),
        F.count(F.when(even, 1)).alias("n_close_call"),
    )
    number = F.substring("version", 6, 9).cast("int")
    versions = Window.partitionBy(F.lit(0))  # one row per version
    return (
        per.withColumn("_n", number)
        .withColumn("_last", F.max("_n").over(versions))
        .select(
            "version",
            (F.col("created_us") + DAY).alias("ready_us"),
            F.when(F.col("_n") == F.col("_last"), "candidate")
            .when(F.col("_n") == F.col("_last") - 1, "production")
            .when(F.col("_n") % 2 == 0, "retired")
            .otherwise("production")
            .alias("state"),
            F.when(F.col("_n") % 3 == 0, "topk").otherwise("none").alias("capability_tier"),
            F.when(F.col("_n") == 2, "rt-1").otherwise("rt-2").alias("runtime_version"),
            "ece_global", "ece_close_call", "n_global", "n_close_call",
        )
    )


@query("newest_ready", """
select capability_tier, arg_max(version, ready_us) as version, max(ready_us) as ready_us from v_registry
where state = 'production' group by 1
""")
def newest_ready(spark, sf):
    return governance.newest_ready(registry(spark, sf))


@query("calibrator_as_of", """
select d.id, arg_max(r.version, r.ready_us) as as_of_version from v_decision d
left join v_registry r on r.ready_us <= d.ts_us and r.state in ('production','retired')
  and r.capability_tier = case when d.id%2=0 then 'none' else 'topk' end group by 1
""")
def calibrator_as_of(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select(
        "id", "ts_us", F.when(F.col("id") % 2 == 0, "none").otherwise("topk").alias("capability_tier")
    )
    return governance.calibrator_as_of(rows, registry(spark, sf)).select("id", "as_of_version")


@query("mixed_version_filter", """
select id, day from v_version where day // 30 not in (
  select day // 30 from v_version group by 1 having count(distinct calibrator_version) > 1)
""")
def mixed_version_filter(spark, sf):
    rows = fx.view(spark, sf, "v_version").withColumn("month", F.floor(F.col("day") / 30))
    return governance.exclude_mixed(rows, "month").select("id", "day")


@query("promotion_path", """
select c.version, p.version as production, case when c.runtime_version <> 'rt-2' then 'blocked'
  when c.n_global >= 100 and c.n_close_call >= 100 and c.ece_global < p.ece_global and c.ece_close_call < p.ece_close_call
  then 'A' else 'B' end as path
from (select *, case when version = 'cal-v2' then 'candidate' else state end as state2 from v_registry) c
join (select capability_tier, arg_max(version, ready_us) as version, arg_max(ece_global, ready_us) as ece_global,
    arg_max(ece_close_call, ready_us) as ece_close_call from v_registry where state = 'production' and version <> 'cal-v2' group by 1) p
  using (capability_tier)
where c.state2 = 'candidate'
""")
def promotion_path(spark, sf):
    rows = registry(spark, sf).withColumn(
        "state", F.when(F.col("version") == "cal-v2", "candidate").otherwise(F.col("state"))
    )
    return governance.promotion_path(rows, "rt-2")


DUCK_VIEWS["v_shadow"] = """
select agent_id as version, ts_us, outcome, p_wrong, p_wrong * case when agent_id in ('agent_1','agent_2') then 0.4::double else 3::double end
  as challenger_p from v_decision"""


@query("shadow_ready", f"""
select *, coalesce(better, false) and days >= 30 and closed >= 500 as ready from (
  select version, ({AS_OF} - min(ts_us)) / {float(DAY)!r}::double as days, count(outcome) as closed,
    avg((challenger_p - y)*(challenger_p - y)) filter (where outcome is not null)
      < avg((p_wrong - y)*(p_wrong - y)) filter (where outcome is not null) as better
  from (select *, case when outcome='wrong' then 1 else 0 end as y from v_shadow) s group by 1) q
""")
def shadow_ready(spark, sf):
    factor = F.when(F.col("agent_id").isin("agent_1", "agent_2"), F.lit(0.4)).otherwise(F.lit(3.0))
    rows = fx.view(spark, sf, "v_decision").select(
        F.col("agent_id").alias("version"), "ts_us", "outcome", "p_wrong", (F.col("p_wrong") * factor).alias("challenger_p")
    )
    return governance.shadow_ready(rows, AS_OF)


@query("migrate_trust", """
select agent_id, action, band, fingerprint, migration, total * f as n_total, case when f = 0 then 0 else total end as n_own_raw,
  case when f = 0 then 0::double else p_lo end as p_lo, case when f = 0 then 0::double else budget end as budget
from (select *, case fingerprint when 'fp_0' then 'carry' when 'fp_1' then 'halve' else 'reset' end as migration,
  case fingerprint when 'fp_0' then 1::double when 'fp_1' then 0.5::double else 0::double end as f from v_key) k
""")
def migrate_trust(spark, sf):
    rows = key_trust(spark, sf).select(
        "agent_id", "action", "band", "fingerprint", F.col("total").cast("double").alias("n_total"),
        F.col("clean").cast("double").alias("n_clean"), F.col("total").alias("n_own_raw"), "p_lo", "budget",
        F.lit("supervised").alias("state"),
    )
    delta = F.when(F.col("fingerprint") == "fp_0", 0.02).when(F.col("fingerprint") == "fp_1", 0.05).otherwise(0.051)
    return governance.migrate_trust(rows, delta).drop("n_clean", "state")


POINTS = ", ".join(str(p) for p in governance.CURVE_POINTS)


@query("earning_curve", f"""
select agent_id, action, band, n, p_lo, coalesce(budget, 0) as budget, coalesce(budget, 0) / ceiling as share from (
  select *, {x.budget('p_lo', 'ceiling', 'n')} as budget from (
    select *, {x.wilson_low('n', 'n')} as p_lo, {x.ceiling('action', 'band')} as ceiling from (
      select agent_id, action, band, clean, unnest([{POINTS}])::bigint as n from (
        select agent_id, action, band, sum(clean)::bigint as clean from v_key group by 1, 2, 3) s) a where n <= clean) b) c
""")
def earning_curve(spark, sf):
    records = key_trust(spark, sf).groupBy("agent_id", "action", "band").agg(F.sum("clean").alias("n_clean"))
    rows = pricing.with_action_terms(records).withColumn("ceiling", pricing.ceiling(F.col("band")))
    return governance.earning_curve(rows).select(
        "agent_id", "action", "band", "n", "p_lo", F.coalesce("budget", F.lit(0.0)).alias("budget"),
        (F.coalesce("budget", F.lit(0.0)) / F.col("ceiling")).alias("share"),
    )


KILL_LIST = ", ".join(f"'{k}'" for k in governance.KILLS)
P_KILL = "case when kill in ('SOR_UNAVAILABLE','FEATURES_UNAVAILABLE') then 1::double else p_wrong end"
B_KILL = "case when kill = 'LEDGER_ROW_MISSING' then 0::double else earned_budget end"


@query("fail_closed", f"""
with k as (select *, {P_KILL} as p2, {B_KILL} as b2, kill = 'TIER1_UNAVAILABLE' or pii_score is null or pii_score >= 0.5
    or injection_score is null or injection_score >= 0.5 or kill = 'TIER1_PARTIAL' or secret_score >= 0.5
    or coalesce(amount > hard_limit, false) as bad
  from (select *, unnest([{KILL_LIST}]) as kill from v_funded) f),
d as (select kill, {x.decide('p2', 'exposure', 'b2', 'bad')} as v1,
  {x.decide("case when kill in ('TIER2_TIMEOUT','TIER2_UNCONFIGURED') then p2 else p2*0.3::double end", 'exposure', 'b2', 'bad', '1')} as v2 from k),
a as (select kill, count(*) filter (where case when v1 = 'check_harder' then v2 else v1 end = 'act') as acts, count(*) as n from d group by 1)
select kill, acts, n, (select acts from a where kill = 'NONE') as healthy_acts, acts <= (select acts from a where kill = 'NONE') as holds from a
""")
def fail_closed(spark, sf):
    rows = gate.lookup_budget(checked(spark, sf), key_trust(spark, sf))
    return governance.fail_closed_check(rows.withColumnRenamed("earned_budget", "budget"))


# --- sampling ---------------------------------------------------------------------


@query("resume_pending", "select id from v_decision where id not in (select turn_id from v_judge)")
def resume_pending(spark, sf):
    turns = fx.view(spark, sf, "v_decision").select("id")
    done = fx.view(spark, sf, "v_judge").select(F.col("turn_id").alias("id"))
    return sampling.resume_pending(turns, done, "id")


QUOTA = 400
BANDS_IN = ", ".join(f"'{b}'" for b in BAND_NAMES)


@query("quota_sample", f"""
with r as (select id, band, row_number() over (partition by band order by md5(cast(id as varchar)), id) as rn from v_decision)
select id, band from r order by case when band in ({BANDS_IN}) and rn <= {QUOTA // 4} then 0 else 1 end, md5(cast(id as varchar)), id
limit {QUOTA}
""")
def quota_sample(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select("id", "band")
    return sampling.quota_sample(rows, "band", "id", BAND_NAMES, QUOTA)


def intents(spark, sf):
    served = record.pool_intents(pools(spark, sf))
    return served.withColumn("band", pricing.band_of(F.col("amount_paise") * 4.0)).select("order_id", "intent", "band")


def drawn_orders(spark, sf):
    return sampling.round_robin_sample(intents(spark, sf), "order_id", 300)


DUCK_VIEWS["v_intent"] = """
select order_id, intent, case when amount_paise*4 < 2000 then '0-2k' when amount_paise*4 < 10000 then '2k-10k'
  when amount_paise*4 < 50000 then '10k-50k' else '50k+' end as band
from (select order_id, amount_paise, unnest(case pool when 'refunded' then ['already_refunded'] when 'duplicate' then ['legit_duplicate']
  when 'near_duplicate' then ['ambiguous'] else ['non_duplicate_misread','out_of_policy_age','adversarial'] end) as intent from v_pool) q"""


def round_robin_sql(total: int) -> str:
    """One stage per intent: the scarcest one left, its bands taking turns, orders already taken left out."""
    mix = ", ".join(f"({i}, '{name}', {int(round(total * share))})" for i, (name, share) in enumerate(INTENT_MIX))
    stages = [f"""m as (select * from (values {mix}) v(pos, intent, want)),
s as (select m.*, row_number() over (order by (select count(*) from v_intent i where i.intent = m.intent), pos) as stage from m),
u0 as (select order_id, intent, band from v_intent where false)"""]
    for i in range(1, len(INTENT_MIX) + 1):
        stages.append(f"""u{i} as materialized (select * from u{i-1} union all select order_id, intent, band from (
  select *, row_number() over (order by rn, case band when '0-2k' then 0 when '2k-10k' then 1 when '10k-50k' then 2 else 3 end) as k from (
    select v.*, want, row_number() over (partition by band order by md5(cast(order_id as varchar)), order_id) as rn
    from v_intent v join s on s.intent = v.intent and s.stage = {i}
    where order_id not in (select order_id from u{i-1})) q) t where k <= want)""")
    return "with " + ",\n".join(stages) + f"\nselect * from u{len(INTENT_MIX)}"


@query("round_robin_sample", round_robin_sql(300))
def round_robin_sample(spark, sf):
    return drawn_orders(spark, sf)


@query("intent_band_counts", "select intent, band, count(*) as n from v_intent group by all")
def intent_band_counts(spark, sf):
    return intents(spark, sf).groupBy("intent", "band").agg(F.count("*").alias("n"))


@query("population_weights", """
select band, count(*) filter (where id%10 < 3) as drawn, count(*) as population,
  cast(count(*) as double) / count(*) filter (where id%10 < 3) as sampling_weight
from v_decision where band in ('0-2k','2k-10k','10k-50k','50k+') group by 1
""")
def population_weights(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select("id", "band")
    return sampling.population_weights(rows, rows.filter("id % 10 < 3"))


@query("diversified_top_k", """
with r as (select id, agent_id, p_wrong, row_number() over (partition by agent_id order by p_wrong desc, id) as rn from v_decision)
select id, agent_id from r order by case when rn > 1 then 1 else 0 end, p_wrong desc, id limit 20
""")
def diversified_top_k(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select("id", "agent_id", "p_wrong")
    return sampling.diversified_top_k(rows, "agent_id", [F.desc("p_wrong"), F.col("id")], 20, ["id"]).select("id", "agent_id")


@query("decision_routes", """
with o as (select r.id, r.agent_id, r.region, r.action = 'issue_refund' as acting, l.length,
    case when r.region = 'escalate' then -r.amount else coalesce(r.p_wrong, 0) end as lead
  from v_replay r left join v_length l using (id) where r.region in ('act', 'close_call', 'escalate')),
f as (select *, row_number() over (partition by region, agent_id order by acting desc, lead, coalesce(length, 0) desc, id) as rn from o),
n as (select region, count(*) as n, count(*) filter (where acting) as action_n from o group by 1),
k as (select *, cast(row_number() over (partition by region order by acting desc, lead, coalesce(length, 0) desc, id) as int) as place from f where rn = 1)
select case region when 'act' then 'release' when 'close_call' then 'check_harder' else 'human_control' end as route,
  n, action_n, place, id, agent_id from k join n using (region) where place <= 3
""")
def decision_routes(spark, sf):
    rows = replayed(spark, sf).join(fx.view(spark, sf, "v_length").select("id", "length"), "id", "left")
    return reports.decision_routes(rows, "agent_id", "length")


# --- reports ----------------------------------------------------------------------


def scored(spark, sf):
    return replayed(spark, sf)


@query("release_summary", """
select *, cast(released_n as double)/scored as released_share, cast(held_n as double)/scored as held_share from (
  select count(*) as scored, count(*) filter (where region='act') as released_n,
    cast(sum(cast(round(amount*100) as bigint)) filter (where region='act' and action='issue_refund') as bigint) as released_paise,
    count(*) filter (where region='act' and outcome='clean') as released_correct,
    count(*) filter (where region='act' and action='issue_refund') as released_actions,
    count(*) filter (where region='act' and action='issue_refund' and outcome='wrong') as released_wrong_actions,
    count(*) filter (where region<>'act') as held_n,
    cast(sum(cast(round(amount*100) as bigint)) filter (where region<>'act' and action='issue_refund') as bigint) as held_paise,
    count(*) filter (where region<>'act' and action='issue_refund') as held_actions,
    (list(p_wrong order by p_wrong) filter (where region<>'act'))[cast(count(*) filter (where region<>'act') as bigint)//2 + 1] as held_p_median
  from v_replay) q
""")
def release_summary(spark, sf):
    return reports.release_summary(scored(spark, sf))


@query("band_panel", f"""
select band, n, clean, rate, p_lo, case when n > 0 then {x.budget('p_lo', 'ceiling', 'n')} end as budget, ceiling,
  case when n = 0 then 'no decisions' when {x.budget('p_lo', 'ceiling', 'n')} > 0 then 'autonomous' else 'supervised' end as state,
  released, held
from (select *, cast(clean as double)/n as rate, {x.wilson_low('clean', 'n')} as p_lo, {x.ceiling("'issue_refund'", 'band')} as ceiling
  from (select band, count(*) as n, count(*) filter (where outcome='clean') as clean,
    count(*) filter (where region='act') as released, count(*) filter (where region<>'act') as held
    from v_replay where action='issue_refund' and band <> 'over_limit' group by 1) a) b
""")
def band_panel(spark, sf):
    return reports.band_panel(scored(spark, sf))


@query("run_summary", """
select count(*) as n, count(*) filter (where verdict='act') as acted, coalesce(max(exposure) filter (where verdict='act'), 0) as max_exposure,
  cast(count(*) filter (where tier_reached >= 2) as double)/count(*) as firing,
  (list(latency_ms - upstream_ms order by latency_ms - upstream_ms))[count(*)//2 + 1] as p50_added_ms,
  (select string_agg(verdict || '=' || c, ', ' order by verdict || '=' || c) from (select verdict, count(*) as c from v_replay group by 1) v) as verdicts,
  (select string_agg(band || '=' || c, ', ' order by band || '=' || c) from (select band, count(*) as c from v_replay where verdict='act' group by 1) v) as acted_by_band
from v_replay
""")
def run_summary(spark, sf):
    return reports.run_summary(replayed(spark, sf, extra=("latency_ms", "upstream_ms", "tier_reached")))


PCT = "(list(ms order by ms))[cast(least(count(*) - 1, round_even({q}::double*(count(*)-1), 0)) as bigint) + 1]"
LATENCY = f"""
select {{keys}}count(*) as n, {PCT.format(q='0.5')} as p50, {PCT.format(q='0.99')} as p99, max(ms) as max_added,
  cast(count(*) filter (where tier_reached >= 2) as double)/count(*) as firing
from (select *, latency_ms - upstream_ms as ms from v_decision) q {{group}}"""
GATES = "select *, p50 < 40 as p50_ok, p99 < 500 as p99_ok, firing between 0.02 and 0.05 as firing_ok, n >= 1000 as enough from"


@query("latency_summary", f"{GATES} ({LATENCY.format(keys='', group='')}) s")
def latency_summary(spark, sf):
    return reports.latency_summary(fx.view(spark, sf, "v_decision"))


@query("latency_by_agent", f"{GATES} ({LATENCY.format(keys='agent_id, ', group='group by agent_id')}) s")
def latency_by_agent(spark, sf):
    return reports.latency_summary(fx.view(spark, sf, "v_decision"), ["agent_id"])


@query("corpus_payload", """
select count(*) as turns, count(region) as scored, count(*) filter (where outcome='wrong') as wrong,
  count(*) filter (where region='act') as release, count(*) filter (where region='close_call') as check_harder,
  count(*) filter (where region='escalate') as human_control from v_replay
""")
def corpus_payload(spark, sf):
    return reports.corpus_payload(scored(spark, sf))


RATES = ", ".join(x.d(r) for r in reports.ERROR_RATES)
COST_EXPOSURE = f"(amount * ({x.mult(chr(39) + 'issue_refund' + chr(39))}) * scale)"


@query("cost_breakeven", f"""
select band, error_rate, scale, verdict, round(exposure, 4) as exposure, round(budget, 6) as budget, round(review_none, 2) as review_none, review_all,
  round(with_layer, 2) as with_layer, round(review_all - with_layer, 2) as saving_vs_all, round(review_none - with_layer, 2) as saving_vs_none
from (select *, 10000 * error_rate * exposure as review_none, 400000::double as review_all,
    case verdict when 'act' then 10000 * error_rate * exposure
      when 'check_harder' then 10000*0.11::double + 0.8::double*10000*error_rate*exposure + 0.2::double*10000*40 else 400000 end as with_layer
  from (select *, {x.decide('error_rate', 'exposure', 'budget', 'false')} as verdict from (
    select *, {x.budget('p_lo', 'ceiling', 'clean')} as budget from (
      select *, {x.ceiling("'issue_refund'", 'band')} * scale as ceiling, {COST_EXPOSURE} as exposure, {x.wilson_low('clean', 'clean')} as p_lo
      from (select *, unnest([{RATES}]) as error_rate from (select *, unnest([0.5::double, 1::double, 1.5::double]) as scale from (
        select band, avg(amount) as amount, count(*) filter (where outcome='clean') as clean from v_decision
        where action='issue_refund' and band<>'over_limit' group by 1) a) b) c) d) e) f) g
""")
def cost_breakeven(spark, sf):
    out = reports.cost_breakeven(fx.view(spark, sf, "v_decision"))
    out = out.withColumn("exposure", F.round("exposure", 4)).withColumn("budget", F.round("budget", 6))
    return out.withColumns(
        {c: F.round(c, 2) for c in ("review_none", "with_layer", "saving_vs_all", "saving_vs_none")}
    )


@query("param_sweep", """
select agent_id, threshold, count(*) filter (where p_wrong >= threshold) as flagged, count(*) as n from (
  select agent_id, p_wrong, unnest([0.01::double, 0.05::double, 0.1::double, 0.2::double]) as threshold from v_decision) q group by 1, 2
""")
def param_sweep(spark, sf):
    grid = reports.explode_grid(fx.view(spark, sf, "v_decision").select("agent_id", "p_wrong"), threshold=(0.01, 0.05, 0.1, 0.2))
    return grid.groupBy("agent_id", "threshold").agg(
        F.count(F.when(F.col("p_wrong") >= F.col("threshold"), 1)).alias("flagged"), F.count("*").alias("n")
    )


SINCE = 900_000_000_000_000


@query("recent_decisions", f"""
select id, ts_us, verdict from v_replay where ts_us >= {SINCE} and verdict = 'act' order by ts_us desc, id desc limit 100
""")
def recent_decisions(spark, sf):
    rows = scored(spark, sf).select("id", "ts_us", "verdict")
    return reports.recent_decisions(rows, SINCE, "act", 100)


@query("extreme_per_region", """
select region, id, amount, case region when 'act' then 'Autonomous release' when 'escalate' then 'Human control' else 'Deep verification' end as route,
  case region when 'act' then 'fast' when 'escalate' then 'adaptive' else 'deep' end as suggested_mode from (
  select *, row_number() over (partition by region order by case when region='escalate' then -amount else amount end, id) as rn
  from v_replay where action='issue_refund') q where rn = 1
""")
def extreme_per_region(spark, sf):
    return reports.extreme_per_region(scored(spark, sf))


@query("criteria_status", """
with c as (select max(ece) filter (where scope='global') < 0.05 and max(ece) filter (where scope='close_call') < 0.08
    and max(n) filter (where scope='close_call') >= 100 as passed, 'close_call n=' || max(n) filter (where scope='close_call') as evidence from v_by_region),
l as (select p50 < 40 and p99 < 500 and firing between 0.02 and 0.05 and n >= 1000 as passed, 'n=' || n as evidence from (""" + LATENCY.format(keys="", group="") + """) s),
r as (select 1 as criterion, * from c union all select 3, * from l)
select e.criterion, e.name, coalesce(r.passed, e.asserted) as passed, e.source,
  coalesce(r.evidence, case when e.source = 'measured' then 'not run yet' end) as evidence
from (values (1, 'Calibrated probability', null::boolean, 'measured'), (2, 'Autonomy earned, and revoked', null, 'measured'),
  (3, 'Latency bounded', null, 'measured'), (4, 'The layer pays for itself', null, 'measured'),
  (5, 'Reproducible by a stranger', true, 'tests'), (6, 'Fails closed', true, 'tests')) e(criterion, name, asserted, source)
left join r using (criterion)
""")
def criteria_status(spark, sf):
    one = cal.calibration_criteria(region_report(spark, sf)).select(
        F.lit(1).alias("criterion"), "passed",
        F.concat(F.lit("close_call n="), F.col("n_close_call").cast("string")).alias("evidence"),
    )
    latency = reports.latency_summary(fx.view(spark, sf, "v_decision"))
    three = latency.select(
        F.lit(3).alias("criterion"),
        (F.col("p50_ok") & F.col("p99_ok") & F.col("firing_ok") & F.col("enough")).alias("passed"),
        F.concat(F.lit("n="), F.col("n").cast("string")).alias("evidence"),
    )
    return reports.criteria_status(one.unionByName(three))


@query("registry_status", """
select version, state, runtime_version, capability_tier, ece_global from v_registry order by ready_us desc limit 1
""")
def registry_status(spark, sf):
    return reports.registry_status(registry(spark, sf))


@query("judge_cost", """
select turns, tokens_in, tokens_out, tokens_in/1e6::double*0.6::double + tokens_out/1e6::double*2.2::double as cost from (
  select count(*) as turns, cast(floor(sum(length(reply) + length(chunk1))/4) as bigint) + count(*)*120 as tokens_in, count(*)*110 as tokens_out from v_reply) q
""")
def judge_cost(spark, sf):
    turns = fx.replies(spark, sf).withColumn("prompt", F.col("chunks")[0])
    return reports.judge_cost_estimate(turns)



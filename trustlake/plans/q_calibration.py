"""Queries over probabilities, labels and their drift."""

from pyspark.sql import functions as F

from trustlake.operators import calibration as cal
from trustlake.operators import drift
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DAY, DUCK_VIEWS
from trustlake.plans.q_gate import HIT, replayed
from trustlake.plans.registry import query

LABELLED = "outcome is not null"


def is_wrong():
    return F.col("outcome") == "wrong"


def labelled(spark, sf):
    return fx.view(spark, sf, "v_decision").filter(LABELLED).select("id", "ts_us", "agent_id", "p_wrong", "outcome")


@query("quantile_bins", f"""
select agent_id, bin, count(*) as n, min(p_wrong) as p_min, max(p_wrong) as p_max from (
  select agent_id, p_wrong, cast(ntile(10) over (partition by agent_id order by p_wrong, id) - 1 as integer) as bin
  from v_decision where {LABELLED}) q group by all
""")
def quantile_bins(spark, sf):
    binned = cal.quantile_bins(labelled(spark, sf).select("id", "agent_id", "p_wrong"), ["agent_id"], "p_wrong", "id")
    return binned.groupBy("agent_id", "bin").agg(
        F.count("*").alias("n"), F.min("p_wrong").alias("p_min"), F.max("p_wrong").alias("p_max")
    )


BIN_LO, BIN_HI = x.wilson_parts("n_wrong", "n")


def reliability_sql(source: str, key: str) -> str:
    return f"""
select {key}, bin, count(*) as n, avg(p_wrong) as predicted, cast(sum(y) as bigint) as n_wrong,
  sum((p_wrong - y)*(p_wrong - y)) as sq, cast(sum(y) as double)/count(*) as observed
from (select *, cast(ntile(10) over (partition by {key} order by p_wrong, id) - 1 as integer) as bin
  from (select *, case when outcome='wrong' then 1 else 0 end as y from ({source}) s) a) b group by all"""


DUCK_VIEWS["v_bins"] = reliability_sql(f"select * from v_decision where {LABELLED}", "agent_id")
DUCK_VIEWS["v_scoped"] = f"""
select *, 'global' as scope from v_replay where {LABELLED}
union all by name select *, region as scope from v_replay where {LABELLED}"""
DUCK_VIEWS["v_scope_bins"] = reliability_sql("select * from v_scoped", "scope")
DUCK_VIEWS["v_by_region"] = """
select scope, coalesce(max(n2), 0) as n, coalesce(max(ece), 0) as ece, coalesce(max(mce), 0) as mce,
  coalesce(max(brier), 0) as brier
from (values ('global'), ('act'), ('close_call'), ('escalate')) v(scope) left join (
  select scope, cast(sum(n) as bigint) as n2, sum(n*abs(observed-predicted))/sum(n) as ece,
    max(abs(observed-predicted)) as mce, sum(sq)/sum(n) as brier from v_scope_bins group by 1) m using (scope)
group by scope"""


@query("reliability_bins", f"""
select agent_id, bin, n, round(predicted, 9) as predicted, n_wrong, round(sq, 9) as sq, observed, {BIN_LO} as lo, {BIN_HI} as hi
from v_bins
""")
def reliability_bins(spark, sf):
    bins = cal.reliability_bins(labelled(spark, sf), ["agent_id"], "p_wrong", is_wrong(), "id")
    return bins.withColumn("predicted", F.round("predicted", 9)).withColumn("sq", F.round("sq", 9))


@query("reliability", """
select agent_id, cast(sum(n) as bigint) as n, round(sum(n*abs(observed-predicted))/sum(n), 9) as ece,
  round(max(abs(observed-predicted)), 9) as mce, round(sum(sq)/sum(n), 9) as brier from v_bins group by 1
""")
def reliability(spark, sf):
    bins = cal.reliability_bins(labelled(spark, sf), ["agent_id"], "p_wrong", is_wrong(), "id")
    out = cal.reliability(bins, ["agent_id"])
    return out.withColumns({m: F.round(m, 9) for m in ("ece", "mce", "brier")})


def region_report(spark, sf):
    rows = replayed(spark, sf).filter(LABELLED).select("id", "p_wrong", "outcome", "region")
    return cal.reliability_by_region(rows, "p_wrong", is_wrong(), "region", "id")


@query("reliability_by_region", """
select scope, n, round(ece, 9) as ece, round(mce, 9) as mce, round(brier, 9) as brier, n >= 100 as has_power from v_by_region
""")
def reliability_by_region(spark, sf):
    return region_report(spark, sf).withColumns({m: F.round(m, 9) for m in ("ece", "mce", "brier")})


@query("calibration_criteria", """
select round(max(ece) filter (where scope='global'), 9) as ece_global,
  round(max(ece) filter (where scope='close_call'), 9) as ece_close_call, max(n) filter (where scope='close_call') as n_close_call,
  max(ece) filter (where scope='global') < 0.05 and max(ece) filter (where scope='close_call') < 0.08
    and max(n) filter (where scope='close_call') >= 100 as passed from v_by_region
""")
def calibration_criteria(spark, sf):
    out = cal.calibration_criteria(region_report(spark, sf))
    return out.withColumns({m: F.round(m, 9) for m in ("ece_global", "ece_close_call")})


DUCK_VIEWS["v_ranked"] = """
select agent_id, value, count(*) as n, max(avg_rank) as avg_rank from (
  select agent_id, value, rank() over (partition by agent_id order by value)
    + (count(*) over (partition by agent_id, value) - 1)/2.0::double as avg_rank
  from (select concat('agent_', cast(user_id%8 as varchar)) as agent_id, floor(value) as value from events) e) q group by 1, 2"""


@query("average_ranks", "select agent_id, value, n, avg_rank from v_ranked")
def average_ranks(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.concat(F.lit("agent_"), (F.col("user_id") % 8).cast("string")).alias("agent_id"),
        F.floor("value").cast("double").alias("value"),
    )
    return cal.average_ranks(rows, ["agent_id"], "value").select("agent_id", "value", "n", "avg_rank")


DUCK_VIEWS["v_pairs"] = """
select d.agent_id, j.judge_p, case when d.outcome='wrong' then 1 else 0 end as y, d.outcome
from v_judge j join v_decision d on d.id = j.turn_id where d.outcome in ('clean','wrong')"""


def judged_pairs(spark, sf):
    """J11: judgements with the ground truth of their turn."""
    truth = fx.view(spark, sf, "v_decision").filter(F.col("outcome").isin("clean", "wrong")).select(
        F.col("id").alias("turn_id"), "agent_id", F.when(is_wrong(), 1).otherwise(0).alias("y")
    )
    return fx.view(spark, sf, "v_judge").select("turn_id", "judge_p").join(truth, "turn_id")


@query("judged_turns", """
select d.id as turn_id, d.outcome, j.judge_p from v_decision d left join v_judge j on j.turn_id = d.id
""")
def judged_turns(spark, sf):
    judge = fx.view(spark, sf, "v_judge").select("turn_id", "judge_p")
    turns = fx.view(spark, sf, "v_decision").select(F.col("id").alias("turn_id"), "outcome")
    return turns.join(judge, "turn_id", "left")


@query("spearman_by_agent", """
select agent_id, count(*) as n, round(coalesce(case when isnan(corr(rx, ry)) then 0 else corr(rx, ry) end, 0), 6) as rho from (
  select agent_id, rank() over (partition by agent_id order by judge_p)
      + (count(*) over (partition by agent_id, judge_p) - 1)/2.0::double as rx,
    rank() over (partition by agent_id order by y) + (count(*) over (partition by agent_id, y) - 1)/2.0::double as ry
  from v_pairs) q group by 1
""")
def spearman_by_agent(spark, sf):
    return cal.spearman(judged_pairs(spark, sf), ["agent_id"], "judge_p", "y").withColumn("rho", F.round("rho", 6))


@query("distinct_deciles", """
select agent_id, count(distinct least(9, floor(judge_p*10))) as deciles from v_pairs group by 1
""")
def distinct_deciles(spark, sf):
    return cal.distinct_deciles(judged_pairs(spark, sf), ["agent_id"], "judge_p")


@query("ipw_rate", """
select agent_id, count(*) as n, round(sum(y/rate)/sum(1/rate), 9) as ipw_rate from (
  select agent_id, case when outcome='wrong' then 1::double else 0::double end as y,
    case when id%3=0 then 0.25::double else 0.5::double end as rate
  from v_decision where outcome is not null) q group by 1
""")
def ipw_rate(spark, sf):
    rows = fx.view(spark, sf, "v_decision").filter(LABELLED)
    rate = F.when(F.col("id") % 3 == 0, 0.25).otherwise(0.5)
    return cal.ipw_rate(rows, ["agent_id"], is_wrong(), rate).withColumn("ipw_rate", F.round("ipw_rate", 9))


@query("sampling_bias", f"""
select *, naive_rate - ipw_rate as bias from (
  select action, cast(sum(y) as double)/count(*) as naive_rate, count(*) filter (where forced) as n_forced,
    coalesce(round(sum(y) filter (where forced) / nullif(count(*) filter (where forced), 0)::double, 12), 0) as ipw_rate
  from (select action, case when outcome='wrong' then 1 else 0 end as y, {HIT.replace(str(int(0.0033 * 2**32)), str(int(0.05 * 2**32)))} as forced
    from v_decision where outcome is not null) q group by 1) r
""")
def sampling_bias(spark, sf):
    from trustlake.functions.decision import hash_fraction_hit

    rows = fx.view(spark, sf, "v_decision").filter(LABELLED)
    out = cal.sampling_bias(rows, ["action"], is_wrong(), hash_fraction_hit(F.col("id"), 0.05), 0.05)
    return out.withColumn("ipw_rate", F.round("ipw_rate", 12)).withColumn("bias", F.col("naive_rate") - F.col("ipw_rate"))


@query("temporal_split", """
select id, case when row_number() over (order by ts_us, id) <= floor((select count(*) from v_decision) * 0.8::double)
  then 'train' else 'test' end as split from v_decision
""")
def temporal_split(spark, sf):
    return cal.temporal_split(fx.view(spark, sf, "v_decision").select("id", "ts_us"), "ts_us", "id").select("id", "split")


@query("halves", """
select id, case when row_number() over (order by ts_us, id) <= (select count(*) from v_decision) // 2 then 0 else 1 end as half
from v_decision
""")
def halves(spark, sf):
    return cal.halves(fx.view(spark, sf, "v_decision").select("id", "ts_us"), ["ts_us", "id"]).select("id", "half")


SHAPE_OK = """coalesce(json_valid(raw) and json_type(raw) = 'OBJECT'
  and list_sort(json_keys(raw)) = ['p_wrong', 'reasons', 'verdict']
  and json_type(raw, '$.p_wrong') in ('DOUBLE', 'UBIGINT', 'BIGINT')
  and json_type(raw, '$.verdict') = 'VARCHAR' and json_type(raw, '$.reasons') = 'ARRAY', false)"""
DUCK_VIEWS["v_judge_checked"] = f"""
select turn_id, seq, raw, ok and try_cast(raw ->> '$.p_wrong' as double) between 0 and 1
    and raw ->> '$.verdict' in ('correct','questionable','wrong')
    and len(list_filter(json_type(raw, '$.reasons[*]'), lambda t: t <> 'VARCHAR')) = 0 as good
from (select *, {SHAPE_OK} as ok from (select turn_id, seq, case when json_valid(raw) then raw else '[]' end as raw
  from v_judge_raw) j) q"""


def checked_answers(spark, sf):
    return cal.validate_judgements(fx.view(spark, sf, "v_judge_raw"))


@query("validate_judgements", """
select turn_id, case when good then cast(raw ->> '$.p_wrong' as double) end as judge_p,
  case when good then raw ->> '$.verdict' end as judge_verdict,
  case when good then null else 'TIER2_SCHEMA_VIOLATION' end as degraded_reason from v_judge_checked
""")
def validate_judgements(spark, sf):
    return checked_answers(spark, sf).select("turn_id", "judge_p", "judge_verdict", "degraded_reason")


@query("schema_violation_rate", """
select *, rate <= 0.02 as within_limit from (select count(*) as attempts, count(*) filter (where not good) as violations,
  cast(count(*) filter (where not good) as double)/count(*) as rate from v_judge_checked) q
""")
def schema_violation_rate(spark, sf):
    return cal.schema_violation_rate(checked_answers(spark, sf), F.col("degraded_reason").isNotNull())


@query("validate_agent_output", """
select turn_id, not (turn_id%40 in (1,2,3,4,5)) as valid, case when not (turn_id%40 in (1,2,3,4,5)) then turn_id%1000 end as amount_paise
from v_agent_raw
""")
def validate_agent_output(spark, sf):
    out = cal.validate_agent_output(fx.view(spark, sf, "v_agent_raw"))
    return out.select("turn_id", "valid", F.when(F.col("valid"), F.col("action.amount_paise")).alias("amount_paise"))


@query("base_rates", """
select action, count(*) as n, avg(case when outcome='wrong' then 1 else 0 end) as base_rate
from v_decision where outcome is not null group by rollup (action)
""")
def base_rates(spark, sf):
    return cal.base_rates(fx.view(spark, sf, "v_decision"))


FOUR = ("quantity", "price", "discount", "tax")
DUCK_VIEWS["v_long"] = """
select feature, value, half from (select *, case when row_number() over (order by row_us, row_key, part, supp)
    <= (select count(*) from v_feature) // 2 then 0 else 1 end as half from v_feature) f
unpivot (value for feature in (quantity, price, discount, tax))"""
DUCK_VIEWS["v_edges"] = """
select feature, list(value order by i) as edges from (
  select feature, value, row_number() over (partition by feature order by value) - 1 as rn,
    count(*) over (partition by feature) as n from v_long where half = 0) r
join (select unnest(range(1, 10)) as i) g on rn = least(n - 1, cast(round_even(i*n/10.0::double, 0) as bigint))
group by 1"""
DUCK_VIEWS["v_psi"] = f"""
select feature, cast(max(n_ref) as bigint) as n_ref, cast(max(n_cur) as bigint) as n_cur,
  sum((c - r)*ln(c/r)) as psi from (
  select feature, n_ref, n_cur, greatest(cr/n_ref, {x.d(1e-6)}) as r, greatest(cc/n_cur, {x.d(1e-6)}) as c from (
    select g.feature, g.b, coalesce(max(cr), 0)::double as cr, coalesce(max(cc), 0)::double as cc,
      max(n_ref)::double as n_ref, max(n_cur)::double as n_cur
    from (select feature, unnest(range(0, 10)) as b, count(*) filter (where half=0) as n_ref,
        count(*) filter (where half=1) as n_cur from v_long group by 1) g
    left join (select feature, len(list_filter(edges, lambda e: e < value)) as b, count(*) filter (where half=0) as cr,
        count(*) filter (where half=1) as cc from v_long join v_edges using (feature) group by 1, 2) h using (feature, b)
    group by 1, 2) k) p group by 1"""


def feature_rows(spark, sf):
    return fx.view(spark, sf, "v_feature")


ORDER = ("row_us", "row_key", "part", "supp")


@query("quantile_edges", """
select feature, array_to_string(list_transform(edges, lambda e: cast(round(e * 100) as bigint)), ',') as edges from v_edges
""")
def quantile_edges(spark, sf):
    half = cal.halves(feature_rows(spark, sf), ORDER).filter("half = 0")
    edges = drift.quantile_edges(drift.unpivot(half, [], FOUR), ["feature"])
    text = F.array_join(F.transform("edges", lambda e: F.round(e * 100).cast("bigint").cast("string")), ",")
    return edges.select("feature", text.alias("edges"))


@query("psi_features", "select feature, n_ref, n_cur, round(psi, 6) as psi from v_psi")
def psi_features(spark, sf):
    half = cal.halves(feature_rows(spark, sf), ORDER)
    return drift.psi(half, "half", FOUR).withColumn("psi", F.round("psi", 6))


@query("distribution_stability", "select feature, n_ref, n_cur, round(psi, 6) as psi, psi > 0.1 as breach from v_psi")
def distribution_stability(spark, sf):
    return drift.distribution_stability(feature_rows(spark, sf), ORDER, FOUR).withColumn("psi", F.round("psi", 6))


@query("null_rates", """
select feature, null_rate from (select avg((pii_score is null)::int) as pii_score, avg((injection_score is null)::int) as injection_score,
  avg((verify_fail_frac is null)::int) as verify_fail_frac, avg((secret_score is null)::int) as secret_score from v_signal) q
unpivot (null_rate for feature in (pii_score, injection_score, verify_fail_frac, secret_score))
""")
def null_rates(spark, sf):
    return drift.null_rates(
        fx.view(spark, sf, "v_signal"), ("pii_score", "injection_score", "verify_fail_frac", "secret_score")
    )


@query("unavailable_rates", """
select flag, rate, rate < 0.05 as inside from (select avg((pii_score is null)::int) as pii_score_unavailable,
  avg((id%2=0)::int) as length_z_unavailable from v_signal) q
unpivot (rate for flag in (pii_score_unavailable, length_z_unavailable))
""")
def unavailable_rates(spark, sf):
    rows = fx.view(spark, sf, "v_signal").select(
        F.col("pii_score").isNull().cast("int").alias("pii_score_unavailable"),
        (F.col("id") % 2 == 0).cast("int").alias("length_z_unavailable"),
    )
    return drift.unavailable_rates(rows, ("pii_score_unavailable", "length_z_unavailable"))


SPLIT_AT = 890_000_000_000_000
YEAR = 365 * DAY
DUCK_VIEWS["v_drift_edges"] = f"""
select agent_id, list(p_wrong order by i) as edges from (
  select agent_id, p_wrong, row_number() over (partition by agent_id order by p_wrong) - 1 as rn,
    count(*) over (partition by agent_id) as n from v_decision where ts_us < {SPLIT_AT}) r
join (select unnest(range(1, 10)) as i) g on rn = least(n - 1, cast(round_even(i*n/10.0::double, 0) as bigint)) group by 1"""


def drift_sql(width: int) -> str:
    return f"""
with l as (select agent_id, len(list_filter(edges, lambda e: e < p_wrong)) as b, ts_us < {SPLIT_AT} as is_ref,
    cast(floor(ts_us / cast({width} as double)) as bigint) as day from v_decision join v_drift_edges using (agent_id)),
r as (select agent_id, b, count(*)::double as cr from l where is_ref group by all),
c as (select agent_id, day, b, count(*)::double as cc from l where not is_ref group by all),
g as (select agent_id, day, unnest(range(0, 10)) as b from (select distinct agent_id, day from c) k),
nr as (select agent_id, sum(cr) as n_ref from r group by 1), nc as (select agent_id, day, sum(cc) as n_cur from c group by 1, 2),
p as (select g.agent_id, g.day, n_ref, n_cur, greatest(coalesce(cr, 0)/n_ref, {x.d(1e-6)}) as r,
    greatest(coalesce(cc, 0)/n_cur, {x.d(1e-6)}) as c
  from g join nr using (agent_id) join nc using (agent_id, day) left join r using (agent_id, b) left join c using (agent_id, day, b))
select agent_id, day, cast(max(n_ref) as bigint) as n_ref, cast(max(n_cur) as bigint) as n_cur, round(sum((c-r)*ln(c/r)), 6) as psi,
  case when max(n_cur) < 100 then 'insufficient_data' when sum((c-r)*ln(c/r)) > 0.2 then 'L1' else 'ok' end as verdict
from p group by 1, 2"""


@query("windowed_drift", drift_sql(YEAR))
def windowed_drift(spark, sf):
    rows = fx.view(spark, sf, "v_decision").select("agent_id", "ts_us", "p_wrong")
    out = drift.windowed_drift(rows, "p_wrong", ["agent_id"], SPLIT_AT, YEAR)
    return out.withColumn("psi", F.round("psi", 6))


@query("drift_verdicts", """
select id, case when id%300 < 100 then 'insufficient_data' when p_wrong > 0.25 and id%4 = 0 then 'L3'
  when id%5 = 0 and p_wrong*1.5::double > 0.25 then 'L2' when p_wrong*2 > 0.2 then case when id%4 = 1 then 're_anchor' else 'L1' end
  else 'ok' end as verdict from v_decision
""")
def drift_verdicts(spark, sf):
    p, i = F.col("p_wrong"), F.col("id")
    long = F.when(i % 4 == 0, F.when(p > 0.25, 0.5).otherwise(0.2)).when(i % 4 == 1, 0.05)
    return fx.view(spark, sf, "v_decision").select(
        "id", drift.drift_verdict(i % 300, p * 2, long, F.when(i % 5 == 0, p * 1.5)).alias("verdict")
    )




SEASON = 90 * DAY
#: In a season, how many tenths of the ids have their probability halved twice; long runs, jumps and returns.
TENTHS = (0, 0, 4, 4, 0, 5, 6, 6, 3, 0)
DUCK_VIEWS["v_season"] = f"""
select action, day, is_ref, case when not is_ref and id % 10 < [{", ".join(map(str, TENTHS))}][day % {len(TENTHS)} + 1]
  then p_wrong * {x.d(0.25)} else p_wrong end as p
from (select id, action, p_wrong, ts_us < {SPLIT_AT} as is_ref,
  cast(floor(ts_us / cast({SEASON} as double)) as bigint) as day from v_decision) q"""


def season_psi(ref: str, cur: str) -> str:
    share = lambda of: f"greatest({of}[b] / list_sum({of})::double, {x.d(1e-6)})"
    return (
        f"case when list_sum({ref}) > 0 and list_sum({cur}) > 0 then "
        f"list_sum(list_transform(range(1, 11), lambda b: ({share(cur)} - {share(ref)}) * ln({share(cur)} / {share(ref)}))) end"
    )


def season_verdict(n: str, short: str, long: str, anchor: str) -> str:
    return (
        f"case when {n} < 100 then 'insufficient_data' when coalesce({long} > 0.3, false) then 'L3' "
        f"when coalesce({anchor} > 0.25, false) then 'L2' when {short} > 0.2 and coalesce({long} <= 0.1, false) then 're_anchor' "
        f"when {short} > 0.2 then 'L1' else 'ok' end"
    )


@query("drift_monitor", f"""
with recursive e as (
  select action, list(p order by i) as edges from (
    select action, p, row_number() over (partition by action order by p) - 1 as rn, count(*) over (partition by action) as n
    from v_season where is_ref) r
  join (select unnest(range(1, 10)) as i) g on rn = least(n - 1, cast(round_even(i*n/10.0::double, 0) as bigint)) group by 1),
b as (select action, day, is_ref, len(list_filter(edges, lambda e: e < p)) as b from v_season join e using (action)),
h as (select action, day, is_ref, count(*) as n, {", ".join(f"count(*) filter (b = {i}) as c{i}" for i in range(10))} from b group by 1, 2, 3),
ref as (select action, [{", ".join(f"sum(c{i})" for i in range(10))}] as ref from h where is_ref group by 1),
d as (select action, day, n, [{", ".join(f"c{i}" for i in range(10))}] as cur,
    [{", ".join(f"sum(c{i}) over w" for i in range(10))}] as past, row_number() over (partition by action order by day) as i
  from h where not is_ref window w as (partition by action order by day rows between 3 preceding and 1 preceding)),
s as (select action, i, day, n, cur, ref, {season_psi("past", "cur")} as short, {season_psi("ref", "cur")} as long from d join ref using (action)),
r as (
  select action, i, day, n, cur, short, long, ref as base, null::bigint as anchored, {season_psi("ref", "cur")} as drift from s where i = 1
  union all
  select s.action, s.i, s.day, s.n, s.cur, s.short, s.long, q.base, q.anchored, {season_psi("q.base", "s.cur")}
  from (select *, case when v = 're_anchor' then cur else base0 end as base, case when v = 're_anchor' then day else anchored0 end as anchored
    from (select action, i, day, cur, base as base0, anchored as anchored0, {season_verdict("n", "short", "long", "drift")} as v from r) t) q
  join s on s.action = q.action and s.i = q.i + 1)
select action, day, n, round(short, 6) as psi_short, round(long, 6) as psi_long, round(drift, 6) as psi_drift, anchored,
  {season_verdict("n", "short", "long", "drift")} as verdict from r
""")
def drift_monitor(spark, sf):
    season = F.floor(F.col("ts_us") / SEASON).cast("bigint")
    tenths = F.element_at(F.array(*map(F.lit, TENTHS)), (season % len(TENTHS) + 1).cast("int"))
    rows = fx.view(spark, sf, "v_decision").select(
        "action",
        season.alias("day"),
        (F.col("ts_us") < SPLIT_AT).alias("is_ref"),
        F.when((F.col("ts_us") >= SPLIT_AT) & (F.col("id") % 10 < tenths), F.col("p_wrong") * 0.25).otherwise(F.col("p_wrong")).alias("value"),
    )
    reference, current = rows.filter("is_ref"), rows.filter("not is_ref")
    edges = drift.quantile_edges(reference, ["action"])
    fixed = drift.window_histograms(reference, "value", ["action"], edges, F.lit(0), prefix="r").drop("day")
    days = drift.window_histograms(current, "value", ["action"], edges, F.col("day"))
    out = drift.monitor(days, fixed, ["action"], "day", short=3)
    return out.withColumns({c: F.round(c, 6) for c in ("psi_short", "psi_long", "psi_drift")})

"""Queries that fit models or go through files."""

from pyspark.sql import functions as F

from trustlake import jobs
from trustlake.functions.decision import hash_fraction_hit
from trustlake.operators import models
from trustlake.operators.gate import TRUST_KEYS
from trustlake.plans import fixtures as fx
from trustlake.plans import sqlx as x
from trustlake.plans.fixtures import DUCK_VIEWS
from trustlake.plans.q_calibration import is_wrong
from trustlake.plans.q_gate import AS_OF
from trustlake.plans.q_trust import accepted, assembled
from trustlake.plans.registry import query
from trustlake.sources import tables


def vectors(spark, sf):
    """Decisions with a four-part numeric vector."""
    return fx.view(spark, sf, "v_signal").select(
        "id", "ts_us", "agent_id", "outcome",
        F.array(
            F.col("p_wrong") * 10,
            F.coalesce("pii_score", F.lit(0.0)),
            F.coalesce("verify_fail_frac", F.lit(0.0)),
            F.col("verify_fail_frac").isNull().cast("double"),
        ).alias("vector"),
    )


@query("fit_calibrator")
def fit_calibrator(spark, sf):
    rows = vectors(spark, sf)
    fitted = models.fit_calibrator(rows.filter("outcome is not null"), "vector", is_wrong())
    return fitted.transform(rows, "vector").select("id", F.round("p_wrong", 6).alias("p_wrong"))


@query("expanding_crossfit")
def expanding_crossfit(spark, sf):
    out = models.expanding_crossfit(vectors(spark, sf), "vector", "ts_us", "id")
    return out.select("id", "block", F.round("p_wrong", 6).alias("p_wrong"))


def gradient(rows, p, vector, wrong, weights, n, c=1.0):
    """Per coefficient (the last one is the intercept) the slope of the penalised mean loss; 0 at the optimum."""
    k = len(weights)
    error = F.col(p) - wrong.cast("double")
    parts = [F.avg(error * F.col(vector)[i].cast("double")) for i in range(k)] + [F.avg(error)]
    penalty = [w / (c * n) for w in weights] + [0.0]
    slopes = F.array(*[F.struct(F.lit(i).alias("i"), (g + F.lit(w)).alias("g")) for i, (g, w) in enumerate(zip(parts, penalty))])
    return rows.agg(F.explode(slopes).alias("s")).select(
        F.col("s.i").alias("coefficient"), F.round(F.abs(F.col("s.g")), 5).alias("slope")
    )


def block_slopes(rows, vector, models_of, inputs, wrong=None):
    """(block, coefficient, slope) of each block's model on the labelled rows before the block, in one pass."""
    wrong = F.col("outcome") == "wrong" if wrong is None else wrong
    past = rows.filter(F.col("outcome").isin("clean", "wrong"))
    out = None
    for b, fitted in enumerate(models_of, 1):
        score = models.score_column(fitted, [F.col(vector)[i] for i in range(inputs)])
        here = gradient(
            past.filter(F.col("block") < b).withColumn("_p", score), "_p", vector, wrong, list(fitted.model.coefficients), fitted.n
        ).withColumn("block", F.lit(b))
        out = here if out is None else out.unionByName(here)
    return out.select("block", "coefficient", "slope")


def no_block_slopes(parts: int) -> str:
    return f"""
select cast(b as integer) as block, cast(i as integer) as coefficient, cast(0 as double) as slope from range(1, 5) bs(b), range({parts}) r(i)"""


def no_slope(parts: int) -> str:
    return f"select cast(i as integer) as coefficient, cast(0 as double) as slope from range({parts}) r(i)"


@query("fit_calibrator_optimum", no_slope(5))
def fit_calibrator_optimum(spark, sf):
    """The fitted calibrator has no slope left in any coefficient, summed over all labelled rows."""
    rows = vectors(spark, sf).filter("outcome is not null")
    fitted = models.fit_calibrator(rows, "vector", is_wrong())
    return gradient(fitted.transform(rows, "vector"), "p_wrong", "vector", is_wrong(), list(fitted.model.coefficients), fitted.n)


@query("fit_policy_head_optimum", no_slope(65))
def fit_policy_head_optimum(spark, sf):
    rows = fx.table(spark, sf, "embeddings").withColumn("_e", F.transform("embedding", lambda v: v.cast("double")))
    wrong = F.col("label") < 2
    fitted = models.fit_policy_head(rows, "embedding", wrong)
    return gradient(fitted.transform(rows, "_e"), "p_wrong", "_e", wrong, list(fitted.model.coefficients), fitted.n)


@query("crossfit_policy_head", """
select id, block, case when block = 0 then 1 else 0 end as policy_score_unavailable from (
  select id, cast(least(4, (row_number() over (order by ts_us, id) - 1) // greatest(1, count(*) over () // 5)) as integer) as block
  from v_decision join embeddings on vec_id = id) q
""")
def crossfit_policy_head(spark, sf):
    """Every block after the first has a score of a head fitted on the blocks before it."""
    rows = fx.view(spark, sf, "v_decision").select("id", "ts_us", "outcome").join(
        fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id"
    )
    out = models.crossfit_policy_head(rows, "embedding", "ts_us", "id")
    return out.select("id", "block", "policy_score_unavailable")


@query("crossfit_base_block", """
with b as (select id, outcome, least(4, (row_number() over (order by ts_us, id) - 1) // greatest(1, (select count(*) from v_decision) // 5)) as block
  from v_decision)
select id, round((select avg(case when outcome = 'wrong' then 1 else 0 end) from b where outcome in ('clean', 'wrong')), 9) as p_wrong
from b where block = 0
""")
def crossfit_base_block(spark, sf):
    """The first block of the cross-fit has no past and carries the base rate."""
    out = models.expanding_crossfit(vectors(spark, sf), "vector", "ts_us", "id")
    return out.filter("block = 0").select("id", F.round("p_wrong", 9).alias("p_wrong"))


@query("crossfit_optimum", no_block_slopes(5))
def crossfit_optimum(spark, sf):
    """The model that scores a block has no slope left on the rows before the block, for every block that has one."""
    rows = models.time_blocks(vectors(spark, sf), "ts_us", "id")
    return block_slopes(rows, "vector", models.block_models(rows, "vector"), 4)


@query("crossfit_scores", """
with b as (select id, cast(least(4, (row_number() over (order by ts_us, id) - 1) // greatest(1, (select count(*) from v_decision) // 5)) as integer) as block
  from v_decision)
select id, block, true as by_its_model from b where block > 0
""")
def crossfit_scores(spark, sf):
    """Every row after the first block has the score of the model that was fitted on the blocks before its own."""
    rows = models.time_blocks(vectors(spark, sf), "ts_us", "id")
    want = F.lit(None).cast("double")
    for b, fitted in enumerate(models.block_models(rows, "vector"), 1):
        score = models.score_column(fitted, [F.col("vector")[i] for i in range(4)])
        want = F.when(F.col("block") == b, score).otherwise(want)
    out = models.expanding_crossfit(vectors(spark, sf), "vector", "ts_us", "id").filter("block > 0")
    return out.select("id", "block", (F.abs(F.col("p_wrong") - want) < 1e-9).alias("by_its_model"))


def judged_scores(spark, sf):
    """Judged decisions with both probabilities."""
    judge = fx.view(spark, sf, "v_judge").select(F.col("turn_id").alias("id"), "judge_p")
    return fx.view(spark, sf, "v_decision").select("id", "ts_us", "outcome", "p_wrong").join(judge, "id")


@query("fit_second_optimum", no_slope(4))
def fit_second_optimum(spark, sf):
    """The second calibrator stacks probability and judgement and has no slope left in any coefficient."""
    rows = judged_scores(spark, sf).filter("outcome is not null")
    fitted = models.fit_second(rows, "p_wrong", "judge_p", is_wrong())
    parts = F.array(*models.stacked_inputs(F.col("p_wrong"), F.col("judge_p")).values())
    scored = rows.withColumns({"_x": parts, "_p": models.second_column(fitted, F.col("p_wrong"), F.col("judge_p"))})
    return gradient(scored.filter("judge_p is not null"), "_p", "_x", is_wrong(), list(fitted.model.coefficients), fitted.n)


@query("second_out_of_fold", """
with b as (select id, least(4, (row_number() over (order by ts_us, id) - 1) // greatest(1, count(*) over () // 5)) as block, judge_p
  from v_decision join v_judge on turn_id = id)
select id, cast(block as integer) as block, block > 0 and judge_p is not null as scored from b
""")
def second_out_of_fold(spark, sf):
    """Every judged row after the first block has a second score from the blocks before its own."""
    out = models.crossfit_second(judged_scores(spark, sf), "p_wrong", "judge_p", "ts_us", "id")
    inside = F.col("p_second").isNotNull() & F.col("p_second").between(0.0, 1.0)
    return out.select("id", "block", inside.alias("scored"))


PLATT_X = f"ln(greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, p_wrong)) / (1 - greatest({x.d(1e-6)}, least({x.d(1 - 1e-6)}, p_wrong))))"


@query("fit_platt_steps", f"""
with recursive f as (
  select agent_id, {PLATT_X} as x, count(*)::double as n, count(*) filter (where outcome = 'wrong')::double as w
  from v_decision where outcome is not null group by all),
s(agent_id, step, a, b) as (
  select distinct agent_id, 0, 1::double, 0::double from f
  union all
  select s.agent_id, s.step + 1,
    any_value(s.a) - 0.1::double * sum((f.n / (1 + exp(-(s.a * f.x + s.b))) - f.w) * f.x) / sum(f.n),
    any_value(s.b) - 0.1::double * sum(f.n / (1 + exp(-(s.a * f.x + s.b))) - f.w) / sum(f.n)
  from s join f using (agent_id) where s.step < 20 group by s.agent_id, s.step)
select agent_id, round(a, 5) as a, round(b, 5) as b from s where step = 20
""")
def fit_platt_steps(spark, sf):
    """Twenty steps of the Platt fit, checked against the same steps in SQL."""
    rows = fx.view(spark, sf, "v_decision").filter("outcome is not null")
    out = models.fit_platt(rows, ["agent_id"], "p_wrong", is_wrong(), iterations=20)
    return out.select("agent_id", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@query("time_blocks", """
select id, cast(least(4, (row_number() over (order by ts_us, id) - 1) // greatest(1, (select count(*) from v_decision) // 5)) as integer) as block
from v_decision
""")
def time_blocks(spark, sf):
    return models.time_blocks(fx.view(spark, sf, "v_decision").select("id", "ts_us"), "ts_us", "id").select("id", "block")


@query("fit_platt")
def fit_platt(spark, sf):
    rows = fx.view(spark, sf, "v_decision").filter("outcome is not null")
    out = models.fit_platt(rows, ["agent_id"], "p_wrong", is_wrong())
    return out.withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))


@query("fit_policy_head")
def fit_policy_head(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    fitted = models.fit_policy_head(rows, "embedding", F.col("label") < 2)
    vector = rows.withColumn("_e", F.transform("embedding", lambda v: v.cast("double")))
    return fitted.transform(vector, "_e", "policy_score").select("vec_id", F.round("policy_score", 5).alias("policy_score"))


@query("spill_replay", "select id, agent_id, p_wrong from v_decision")
def spill_replay(spark, sf):
    """The log lost every fifth row to the spill, and some rows are in both."""
    rows = fx.view(spark, sf, "v_decision").select("id", "agent_id", "p_wrong")
    log = rows.filter("id % 5 <> 0 or id % 2 = 0")
    spilled = rows.filter("id % 5 = 0").unionByName(rows.filter("id % 10 = 5"))
    return tables.replay_spill(log, spilled)


AFTER_WEIGHT = x.evidence("source", "outcome_us", "ts_us", AS_OF)
DUCK_VIEWS["v_after"] = """
select d.* exclude (outcome, source, outcome_us), coalesce(d.outcome, c.outcome) as outcome,
  case when c.outcome is not null then c.outcome_source else d.source end as source,
  case when c.outcome is not null then c.outcome_us else d.outcome_us end as outcome_us
from v_decision d left join v_closed_all c on c.decision_id = d.id"""
DUCK_VIEWS["v_closed_all"] = f"""
select decision_id, outcome, source as outcome_source, reported_us as outcome_us from (
  select e.*, row_number() over (partition by e.decision_id order by weight desc, reported_us desc, event_id desc) as rn
  from v_accepted e join v_decision d on d.id = e.decision_id
  where e.processed_us is null and d.outcome is null and d.horizon_us <= {AS_OF}) w where rn = 1"""


@query("nightly", f"""
select agent_id, action, band, fingerprint, round(sum(case when outcome in ('clean','wrong') then {AFTER_WEIGHT} else 0 end), 6) as n_total,
  count(*) filter (where outcome in ('clean','wrong')) as n_own_raw,
  count(*) filter (where from_end <= 100 and outcome='wrong') >= 3 as tripped, count(*) >= 100 as checked
from (select *, row_number() over (partition by agent_id, action, band, fingerprint order by ts_us desc, id desc) as from_end from v_after) q
where action in ('issue_refund','send_bulk_email') and band in ('0-2k','2k-10k','10k-50k','50k+') group by 1, 2, 3, 4
""")
def nightly(spark, sf):
    out = jobs.nightly(fx.view(spark, sf, "v_decision"), accepted(spark, sf), AS_OF)
    return out["trust"].join(out["drift_checks"], list(TRUST_KEYS)).select(
        *TRUST_KEYS, F.round("n_total", 6).alias("n_total"), "n_own_raw",
        F.col("tripped_at").isNotNull().alias("tripped"), (F.col("verdict") == "checked").alias("checked"),
    )


def corpus(spark, sf):
    return assembled(spark, sf).select("id", "ts_us", "action", "amount", "band", "outcome", "features")


@query("bootstrap_scored")
def bootstrap_scored(spark, sf):
    return jobs.bootstrap(corpus(spark, sf))["scored"].select("id", "split", "p_wrong", "verdict", "region", "own_total")


@query("bootstrap_trust", f"""
select 'agent_corpus' as agent_id, action, band, n_clean, n_total, p_lo, ceiling, coalesce({x.budget('p_lo', 'ceiling', 'n_total')}, 0) as budget
from (select *, {x.wilson_low('n_clean', 'n_total')} as p_lo, {x.ceiling('action', 'band')} as ceiling from (
  select action, band, count(*) filter (where outcome='clean') as n_clean, count(*) as n_total from v_decision
  where outcome is not null and action in ('issue_refund','send_bulk_email') and band in ('0-2k','2k-10k','10k-50k','50k+') group by 1, 2) a) b
""")
def bootstrap_trust(spark, sf):
    return jobs.bootstrap(corpus(spark, sf))["trust"].drop("state")


@query("bootstrap_baseline", """
with o as (select id, ts_us, outcome, row_number() over (order by ts_us, id) - 1 as rn, count(*) over () as n from v_decision),
s as (select *, rn < cast(floor(n * (1 - 0.2::double)) as bigint) as train from o)
select 'cal-v1' as version, 'none' as capability_tier, min(ts_us) as created_us, max(ts_us) as ready_us, 'production' as state,
  min(ts_us) filter (where not train) as boundary_us, count(*) filter (where train and outcome is not null) as n_train,
  count(*) filter (where not train and outcome is not null) as n_test,
  count(*) filter (where train and outcome is not null and judge_p is not null) as n_second,
  round(avg(case when outcome = 'wrong' then 1 else 0 end) filter (where train and outcome is not null), 9) as fallback_prior
from s left join v_judge on turn_id = id
""")
def bootstrap_baseline(spark, sf):
    """The baseline and the registry row of the first calibrators, one each."""
    judge = fx.view(spark, sf, "v_judge").select(F.col("turn_id").alias("id"), "judge_p")
    turns = corpus(spark, sf).join(judge, "id", "left")
    turns = turns.withColumn("features", F.col("features").withField("judge_p_wrong", F.col("judge_p"))).drop("judge_p")
    out = jobs.bootstrap(turns)
    registry = out["registry"].select("version", "created_us", "ready_us", "state")
    # one row each
    both = out["baseline"].unionByName(registry, allowMissingColumns=True).drop("model_a_features", "model_b_features")
    one = both.groupBy("version").agg(*[F.max(c).alias(c) for c in both.columns if c != "version"])
    return one.select(
        "version", "capability_tier", "created_us", "ready_us", "state", "boundary_us", "n_train", "n_test", "n_second",
        F.round("fallback_prior", 9).alias("fallback_prior"),
    )


@query("review_sample", """
select id from v_decision where ('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint < 214748364
""")
def review_sample(spark, sf):
    return fx.view(spark, sf, "v_decision").filter(hash_fraction_hit(F.col("id"), 0.05)).select("id")

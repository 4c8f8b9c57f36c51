"""Queries over the system of record."""

from pyspark.sql import functions as F

from trustlake.operators import record, reports
from trustlake.plans import fixtures as fx
from trustlake.plans.fixtures import DAY, DUCK_VIEWS
from trustlake.plans.registry import query

DUCK_VIEWS["v_same"] = """
select o.order_id, count(*) as n from v_order o join v_charge c
  on c.order_id = o.order_id and c.amount_paise = o.amount_paise group by 1"""

DUCK_VIEWS["v_fact"] = f"""
select t.*, o.order_id as f_order, o.amount_paise as f_amount, o.status as f_status,
  coalesce(s.n, 0) > 1 as f_dup,
  t.true_order in (select order_id from v_refund) as f_refunded,
  o.delivered_us is not null and t.ts_us - o.delivered_us <= 30*{DAY} as f_window
from v_claim t left join v_order o on o.order_id = t.true_order left join v_same s on s.order_id = t.true_order"""


def facts(spark, sf):
    return record.record_facts(
        fx.order_table(spark, sf), fx.view(spark, sf, "v_charge"), fx.view(spark, sf, "v_refund")
    )


@query("verify_claims", """
select turn_id,
  case when claim_order is null then 0 else 4 end as verify_n_claims,
  case when claim_order is null then cast(0 as double) else cast(
    (case when o.order_id is null then 1 else 0 end)
    + (case when claim_dup = (coalesce(s.n, 0) > 1) then 0 else 1 end)
    + (case when claim_amount = o.amount_paise then 0 else 1 end)
    + (case when claim_refunded = (claim_order in (select order_id from v_refund)) then 0 else 1 end)
  as double) / 4 end as verify_fail_frac
from v_claim left join v_order o on o.order_id = claim_order left join v_same s on s.order_id = claim_order
""")
def verify_claims(spark, sf):
    return record.verify_claims(fx.claim_turns(spark, sf), facts(spark, sf)).select(
        "turn_id", "verify_fail_frac", "verify_n_claims"
    )


@query("gather_facts", """
select turn_id, f_order as order_id, f_amount as amount_paise, f_status as status,
  case when f_order is not null then f_dup end as has_duplicate,
  case when f_order is not null then f_refunded end as already_refunded,
  case when f_order is not null then f_window end as within_window from v_fact
""")
def gather_facts(spark, sf):
    turns = fx.claim_turns(spark, sf)
    return record.gather_facts(turns, F.col("true_order"), facts(spark, sf)).select("turn_id", "facts.*")


@query("label_outcomes", """
with r as (select turn_id, f_order, case when f_order is null then ['order_not_on_record'] else list_filter([
    case when claim_order <> f_order then 'wrong_order' end,
    case when claim_dup and not f_dup then 'claimed_duplicate_that_does_not_exist' end,
    case when claim_refunded <> f_refunded then 'misreported_refund_status' end,
    case when issuing and f_refunded then 'double_refund' end,
    case when issuing and not f_window then 'outside_refund_window' end,
    case when issuing and f_status='CANCELLED' then 'refunded_cancelled_order' end,
    case when issuing and act_amount > f_amount then 'over_refund' end], lambda x: x is not null) end as reasons
  from (select *, act_type='issue_refund' and act_amount > 0 as issuing from v_fact) f)
select turn_id, case when f_order is not null then case when len(reasons) > 0 then 'wrong' else 'clean' end end as outcome,
  array_to_string(reasons, ',') as reasons from r
""")
def label_outcomes(spark, sf):
    turns = record.gather_facts(fx.claim_turns(spark, sf), F.col("true_order"), facts(spark, sf))
    return record.label_outcomes(turns).select(
        "turn_id", "outcome", F.array_join("outcome_reasons", ",").alias("reasons")
    )


POOLS = """
select o.order_id, o.amount_paise, case when o.order_id in (select order_id from v_refund) then 'refunded'
    when o.status <> 'DELIVERED' then null when c.same > 1 then 'duplicate'
    when c.charges > 1 and c.same = 1 then 'near_duplicate' else 'plain' end as pool
from v_order o left join (
  select c.order_id, count(*) as charges, count(*) filter (where c.amount_paise = o2.amount_paise) as same
  from v_charge c join v_order o2 on o2.order_id = c.order_id group by 1) c on c.order_id = o.order_id
where o.delivered_us is not null"""
DUCK_VIEWS["v_pool"] = f"select * from ({POOLS}) where pool is not null"


def pools(spark, sf):
    return record.order_pools(
        fx.order_table(spark, sf), fx.view(spark, sf, "v_charge"), fx.view(spark, sf, "v_refund")
    )


@query("order_pools", "select order_id, pool from v_pool")
def order_pools(spark, sf):
    return pools(spark, sf).select("order_id", "pool")


@query("ledger_lines", """
select order_id, section, line, cast(count(*) as bigint) as n from (
  select order_id, 'charge' as section, charged_us as at_us, '      - ' || amount_paise || ' paise, charged_at '
    || strftime(make_timestamp(charged_us), '%Y-%m-%d') as line from v_charge
  union all
  select order_id, 'refund', issued_us, '      - ' || amount_paise || ' paise, ' || status || ', issued_at '
    || strftime(make_timestamp(issued_us), '%Y-%m-%d') from v_refund) l
group by order_id, section, at_us, line
""")
def ledger_lines(spark, sf):
    lines = record.ledger_lines(fx.view(spark, sf, "v_charge"), fx.view(spark, sf, "v_refund"))
    return lines.select("order_id", "section", "line", "n")


@query("render_context", """
with l as (
  select order_id, 'charge' as section, charged_us as at_us, '      - ' || amount_paise || ' paise, charged_at '
    || strftime(make_timestamp(charged_us), '%Y-%m-%d') as line from v_charge
  union all
  select order_id, 'refund', issued_us, '      - ' || amount_paise || ' paise, ' || status || ', issued_at '
    || strftime(make_timestamp(issued_us), '%Y-%m-%d') from v_refund),
s as (select order_id, string_agg(line, chr(10) order by at_us, line) filter (where section='charge') as charges,
  string_agg(line, chr(10) order by at_us, line) filter (where section='refund') as refunds from l group by 1)
select turn_id, 'Retrieved policy:' || chr(10) || '- p' || (turn_id % 7) || chr(10) || '- q' || chr(10) || chr(10)
  || 'Today''s date is ' || strftime(make_timestamp(ts_us), '%Y-%m-%d') || '.' || chr(10) || chr(10)
  || 'Order record:' || chr(10) || case when o.order_id is null then '  (no order on record)' || chr(10)
  else '  id:                ' || o.order_id || chr(10)
  || '  amount_paise:      ' || o.amount_paise || chr(10) || '  status:            ' || o.status || chr(10)
  || '  delivered_at:      ' || case when o.delivered_us is null then 'never delivered (cancelled)'
     else strftime(make_timestamp(o.delivered_us), '%Y-%m-%d') end || chr(10)
  || '  charge ledger:' || chr(10) || coalesce(charges, '      - (no charges on record)') || chr(10)
  || '  refund ledger:' || chr(10) || coalesce(refunds, '      - (no refunds on record)') || chr(10) end as context
from v_claim t left join v_order o on o.order_id = t.true_order left join s on s.order_id = t.true_order
""")
def render_context(spark, sf):
    turns = fx.claim_turns(spark, sf).withColumn(
        "chunks", F.array(F.concat(F.lit("p"), (F.col("turn_id") % 7).cast("string")), F.lit("q"))
    )
    lines = record.ledger_lines(fx.view(spark, sf, "v_charge"), fx.view(spark, sf, "v_refund"))
    out = record.render_context(turns, F.col("true_order"), fx.order_table(spark, sf), lines)
    return out.select("turn_id", "context")


@query("example_rows", """
select turn_id, 's' || (turn_id % 5) as scenario, 'my order ' || turn_id as customer, 'done ' || turn_id as reply, act_type as action,
  cast(act_amount * 1000 as double) / 100 as amount,
  case when act_amount * 10 > 200000 or act_amount < 0 then null when act_amount * 10 < 2000 then '0-2k'
    when act_amount * 10 < 10000 then '2k-10k' when act_amount * 10 < 50000 then '10k-50k' else '50k+' end as band,
  p_wrong, r.region, d.outcome, case when turn_id % 2 = 0 then 'late' else '' end as reasons
from v_claim c join v_decision d on d.id = c.turn_id join v_replay r on r.id = c.turn_id
""".replace("p_wrong, r.region", "d.p_wrong, r.region"))
def example_rows(spark, sf):
    from trustlake.plans.q_gate import replayed

    t = F.col("turn_id").cast("string")
    regions = replayed(spark, sf).select(F.col("id").alias("turn_id"), "p_wrong", "region", "outcome")
    turns = fx.claim_turns(spark, sf).join(regions, "turn_id").withColumns({
        "scenario": F.concat(F.lit("s"), (F.col("turn_id") % 5).cast("string")),
        "prompt": F.concat(F.lit("Policy.\n\nCustomer says: 'my order "), t, F.lit("'\nReview.")),
        "reply_text": F.concat(F.lit("  done "), t, F.lit("\n")),
        "action": F.col("action").withField("amount_paise", F.col("action.amount_paise") * 1000),
        "outcome_reasons": F.when(F.col("turn_id") % 2 == 0, F.array(F.lit("late"))),
    })
    return reports.example_rows(turns).withColumn("reasons", F.array_join("reasons", ","))

"""Queries that go through the readers and writers, by way of the shared folder."""

from pyspark.sql import functions as F

from trustlake import schemas
from trustlake.operators import features, record
from trustlake.plans import fixtures as fx
from trustlake.plans.fixtures import DAY
from trustlake.plans.q_record import facts
from trustlake.plans.q_trust import accepted
from trustlake.plans.registry import query
from trustlake.sources import tables
from trustlake.streaming.runner import work_folder


@query("read_turns", """
select 'turn' as kind, cast(id as varchar) as turn_id, ts_us from v_decision where id % 50 <> 0
union all select 'broken', '{"turn_id": "' || id, null from v_decision where id % 50 = 0
""")
def read_turns(spark, sf):
    """A corpus file in which every fiftieth line breaks off."""
    folder = work_folder(spark, "turns")
    rows = fx.view(spark, sf, "v_decision")
    line = F.to_json(F.struct(F.col("id").cast("string").alias("turn_id"), (F.col("ts_us") / 1_000_000).alias("ts"), "band"))
    broken = F.concat(F.lit('{"turn_id": "'), F.col("id").cast("string"))
    rows.select(F.when(F.col("id") % 50 == 0, broken).otherwise(line).alias("value")).write.text(folder)
    turns, rest = tables.read_turns(spark, folder)
    return turns.select(F.lit("turn").alias("kind"), "turn_id", "ts_us").unionByName(
        rest.select(F.lit("broken").alias("kind"), F.col("line").alias("turn_id"), F.lit(None).cast("bigint").alias("ts_us"))
    )


@query("read_judgements", """
select cast(turn_id as varchar) as turn_id, arg_max(p_wrong, seq) as p_wrong from (
  select turn_id - turn_id%3 as turn_id, judge_p as p_wrong, turn_id as seq from v_judge) q group by 1
""")
def read_judgements(spark, sf):
    """Files in the order of their lines, in which turns are judged up to three times."""
    folder = work_folder(spark, "judgements")
    rows = fx.view(spark, sf, "v_judge").select(
        F.col("turn_id").alias("line"), (F.col("turn_id") - F.col("turn_id") % 3).cast("string").alias("turn_id"),
        F.col("judge_p").alias("p_wrong"),
    )
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(files, "line").sortWithinPartitions("line").select("turn_id", "p_wrong").write.json(folder)
    return tables.read_judgements(spark, folder)[0].select("turn_id", "p_wrong")


@query("read_record", """
select 'order' as kind, 'ord_' || order_id as id, amount_paise from v_order
union all select 'charge', 'ord_' || order_id, amount_paise from v_charge
union all select 'refund', 'ord_' || order_id, amount_paise from v_refund
union all select 'customer', 'cus_' || c_custkey, null from customer
""")
def read_record(spark, sf):
    """The four tables of the system of record with text ids, written and read with their declared types."""
    folder = work_folder(spark, "record")
    text_id = F.concat(F.lit("ord_"), F.col("order_id").cast("string")).alias("order_id")
    sources = {
        "order": fx.order_table(spark, sf).withColumn("order_id", text_id),
        "charge": fx.view(spark, sf, "v_charge").withColumn("order_id", text_id),
        "refund": fx.view(spark, sf, "v_refund").withColumn("order_id", text_id),
        "customer": fx.table(spark, sf, "customer").select(
            F.concat(F.lit("cus_"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name")
        ),
    }
    for name, df in sources.items():
        fields = schemas.struct(schemas.RECORD[name]).fields
        have = [f for f in fields if f.name in df.columns]
        lack = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in df.columns]
        df.select(*[F.col(f.name).cast(f.dataType) for f in have], *lack).write.parquet(f"{folder}/{name}")
    read = tables.read_record(spark, folder)
    parts = [
        read[n].select(F.lit(n).alias("kind"), F.col("order_id").alias("id"), "amount_paise") for n in ("order", "charge", "refund")
    ]
    people = read["customer"].select(F.lit("customer").alias("kind"), "id", F.lit(None).cast("bigint").alias("amount_paise"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(people)


@query("ensure_tables", "select event_id, cast(decision_id as varchar) as decision_id, outcome, weight from v_accepted")
def ensure_tables(spark, sf):
    """Events appended to an operational table that did not exist before."""
    folder = work_folder(spark, "tables")
    database = "trustlake_" + folder.rsplit("-", 1)[1][:12]
    tables.ensure_tables(spark, database, folder)
    kinds = schemas.struct(schemas.OUTCOME_EVENT).fields
    rows = accepted(spark, sf)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.insertInto(f"{database}.outcome_event")
    return spark.table(f"{database}.outcome_event").select("event_id", "decision_id", "outcome", "weight")


@query("append_decisions", """
select id, agent_id, action, strftime(make_timestamp((ts_us // 86400000000 % 10) * 86400000000), '%Y-%m-%d') as dt from v_decision
""")
def append_decisions(spark, sf):
    """The log of ten days, on which all decisions are dealt."""
    folder = work_folder(spark, "log")
    day = F.floor(F.col("ts_us") / DAY) % 10
    rows = fx.view(spark, sf, "v_decision").withColumn("ts_us", day * DAY)
    kinds = {f.name: f.dataType for f in schemas.struct(schemas.DECISION).fields}
    lack = {n: F.lit(None).cast(kinds[n]) for n in schemas.LOGGED if n not in rows.columns}
    tables.append_decisions(rows.withColumns(lack), folder)
    return spark.read.parquet(folder).select("id", "agent_id", "action", F.col("dt").cast("string").alias("dt"))


@query("write_report", "select band, count(*) as n, cast(sum(cast(round(amount) as bigint)) as bigint) as amount from v_decision group by 1")
def write_report(spark, sf):
    folder = work_folder(spark, "report")
    rows = fx.view(spark, sf, "v_decision").groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.round("amount").cast("bigint")).alias("amount")
    )
    tables.write_report(rows, folder)
    return spark.read.schema("band string, n bigint, amount bigint").json(folder)


@query("register_verifier", """
select turn_id, case when claim_order is null then 0 else 5 end as verify_n_claims,
  case when claim_order is null then cast(0 as double) else cast(
    (case when o.order_id is null then 1 else 0 end)
    + (case when claim_dup = (coalesce(s.n, 0) > 1) then 0 else 1 end)
    + (case when claim_amount = o.amount_paise then 0 else 1 end)
    + (case when claim_refunded = (claim_order in (select order_id from v_refund)) then 0 else 1 end)
    + (case when (turn_id % 2 = 0) = (o.delivered_us is not null) and o.order_id is not null then 0 else 1 end)
  as double) / 5 end as verify_fail_frac
from v_claim left join v_order o on o.order_id = claim_order left join v_same s on s.order_id = claim_order
""")
def register_verifier(spark, sf):
    """A fifth claim, that the order was delivered, checked by a registered verifier."""
    turns = fx.claim_turns(spark, sf)
    claims = F.when(F.col("claims").isNotNull(), F.col("claims").withField("delivered", F.col("turn_id") % 2 == 0))
    record.register_verifier("delivered", lambda claimed: F.col("order_found") & (claimed == F.col("delivered_us").isNotNull()))
    try:
        out = record.verify_claims(turns.withColumn("claims", claims), facts(spark, sf))
    finally:
        del record.VERIFIERS["delivered"]
    return out.select("turn_id", "verify_fail_frac", "verify_n_claims")


@query("feature_cache", """
select s.id as turn_id, pii_score, judge_p as judge_p_wrong, 0 as judge_p_wrong_unavailable, 0 as stale
from v_signal s left join v_judge j on j.turn_id = s.id
""")
def feature_cache(spark, sf):
    """Features written once, read with the judge's answers; a turn that is not in the cache makes it stale."""
    folder = work_folder(spark, "features")
    rows = fx.view(spark, sf, "v_signal").withColumnRenamed("id", "turn_id")
    tables.write_feature_cache(features.assemble_features(rows, F.col("ts_us"), "none"), folder)
    judged = fx.view(spark, sf, "v_judge")
    more = rows.select("turn_id").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("turn_id")))
    stale = int(tables.read_feature_cache(spark, folder, more, judged) is not None)
    out = tables.read_feature_cache(spark, folder, rows, judged)
    return out.select(
        "turn_id", "features.pii_score", "features.judge_p_wrong", "features.judge_p_wrong_unavailable", F.lit(stale).alias("stale")
    )

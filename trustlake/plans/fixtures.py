"""The four table families of this library, derived from the given test tables.

A ``View`` is written once as SQL expressions that mean the same in Spark and in
DuckDB, so a query and its check start from equal rows. ``{us:col}`` stands for
epoch microseconds of a timestamp column, the one spelling that differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US = re.compile(r"\{us:(\w+)\}")


# the declared types of the given tables; nothing is inferred from the files
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def us_of(column: str) -> str:
    """Epoch microseconds of a zone-less timestamp column, whatever the session's time zone."""
    return (
        f"(unix_date(cast({column} as date)) * 86400000000L + hour({column}) * 3600000000L "
        f"+ minute({column}) * 60000000L + cast(extract(second from {column}) * 1000000 as bigint))"
    )


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class View:
    base: str
    steps: tuple[dict[str, str], ...]
    where: str | None = None
    extend: bool = False  # keep the base's columns beside the first step's

    def spark(self, spark: SparkSession, sf: str, source: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """The view as a DataFrame; ``source`` replaces how the base table is read (a stream, say)."""
        read = source or (lambda name: table(spark, sf, name))
        df = VIEWS[self.base].spark(spark, sf, read) if self.base in VIEWS else read(self.base)
        for i, step in enumerate(self.steps):
            exprs = [f"{US.sub(lambda m: us_of(m[1]), e)} as {n}" for n, e in step.items()]
            df = df.selectExpr(*(["*"] if i or self.extend else []), *exprs)
        return df.where(self.where) if self.where else df

    def duck(self) -> str:
        sql = self.base
        for i, step in enumerate(self.steps):
            exprs = ", ".join(f"{US.sub(r'epoch_us(\1)', e)} as {n}" for n, e in step.items())
            sql = f"select {'*, ' if i or self.extend else ''}{exprs} from {sql if sql == self.base else f'({sql}) q{i}'}"
        return f"select * from ({sql}) w where {self.where}" if self.where else sql


def _draw(factor: int, mod: int = 10007, col: str = "o_orderkey") -> str:
    return f"cast(({col}*{factor})%{mod} as double)/cast({mod} as double)"


DAY = 86400000000

VIEWS: dict[str, View] = {}

# one decision per order: the flagship fact table
VIEWS["v_decision"] = View(
    "orders",
    (
        {
            "id": "o_orderkey",
            "agent_id": "concat('agent_', cast(o_custkey%8 as string))",
            "fingerprint": "concat('fp_', cast(o_custkey%3 as string))",
            "action": "case when substr(o_orderpriority,1,1) in ('1','2','3') then 'issue_refund' "
            "when substr(o_orderpriority,1,1)='4' then 'send_bulk_email' else 'no_action' end",
            "amount": "o_totalprice*o_totalprice/cast(1000000 as double)",
            "p_wrong": f"cast(0.3 as double)*({_draw(7919)})*({_draw(7919)})",
            "ts_us": "{us:o_orderdate} + (o_orderkey%86400)*1000000",
            "draw": _draw(104729),
        },
        {
            "outcome": "case when id%10=0 then null when draw < cast(0.5 as double)*p_wrong then 'wrong' else 'clean' end",
            "band": "case when action='no_action' then 'unpriced' when amount<2000 then '0-2k' "
            "when amount<10000 then '2k-10k' when amount<50000 then '10k-50k' "
            "when amount<=200000 then '50k+' else 'over_limit' end",
            "source": "case id%6 when 0 then 'record_verification' when 1 then 'human_override' when 2 then 'reversal' "
            "when 3 then 'user_rework' when 4 then 'offline_judge' else 'rumour' end",
            "outcome_us": f"case when id%7=0 then null else ts_us + (id%30)*{DAY} end",
            "horizon_us": f"ts_us + case when action='issue_refund' then 30*{DAY} "
            f"when action='send_bulk_email' then {DAY} else 0 end",
            "upstream_ms": "cast(200 + id%500 as double)",
            "latency_ms": "cast(200 + id%500 as double) + cast(5 + (id*31)%60 as double) "
            "+ case when id%97=0 then cast(400 as double) else cast(0 as double) end",
            "tier_reached": "case when (id*13)%100 < 3 then 2 else 1 end",
            "policy_mode": "case id%7 when 0 then 'fast' when 1 then 'deep' when 2 then 'turbo' else 'adaptive' end",
        },
    ),
)

# sensor scores of a decision; NULL means the sensor did not answer
VIEWS["v_signal"] = View(
    "v_decision",
    (
        {
            "pii_score": "case when id%53=0 then null when id%41=0 then cast(0.9 as double) else cast(0.05 as double) end",
            "injection_score": "case when id%59=0 then null when id%37=0 then cast(0.5 as double) else cast(0.02 as double) end",
            "secret_score": "case when id%61=0 then cast(1.0 as double) else cast(0.0 as double) end",
            "verify_fail_frac": "case when id%71=0 then null when id%9=0 then cast(0.5 as double) else cast(0.0 as double) end",
            "localised": "id%2=0",
            "retrieval_scope": "cast(case when id%67=0 then 3 else 1 end as int)",
            "user_scope": "cast(2 as int)",
        },
    ),
    extend=True,
)

# a judge's answer for three decisions in ten
VIEWS["v_judge"] = View(
    "v_decision",
    (
        {
            "turn_id": "id",
            "judge_p": "least(cast(1 as double), cast(0.6 as double)*p_wrong + "
            "cast(0.4 as double)*cast((id*31)%101 as double)/cast(101 as double))",
            "model": "'judge-1'",
            "thinking": "'disabled'",
            "seq": "(id*7919)%1000003",
        },
        {"judge_verdict": "case when judge_p<0.2 then 'correct' when judge_p<0.4 then 'questionable' else 'wrong' end"},
    ),
    where="turn_id%10 < 3",
)

# the same answers as raw JSON text, some of them broken in four ways
VIEWS["v_judge_raw"] = View(
    "v_judge",
    (
        {
            "turn_id": "turn_id",
            "seq": "seq",
            "raw": "case when turn_id%50=0 then '{{\"p_wrong\": \"0.5\", \"verdict\": \"wrong\", \"reasons\": []}}' "
            "when turn_id%50=1 then '{{\"p_wrong\": true, \"verdict\": \"wrong\", \"reasons\": []}}' "
            "when turn_id%50=2 then '{{\"p_wrong\": 0.5, \"verdict\": \"wrong\", \"reasons\": [], \"note\": \"x\"}}' "
            "when turn_id%50=10 then 'I think this is fine.' "
            "when turn_id%50=11 then '{{\"p_wrong\": 1.5, \"verdict\": \"wrong\", \"reasons\": []}}' "
            "when turn_id%50=12 then '{{\"p_wrong\": 0.5, \"verdict\": \"maybe\", \"reasons\": []}}' "
            "when turn_id%50=20 then '{{\"p_wrong\": 0.5, \"verdict\": \"wrong\", \"reasons\": [\"a\", 3]}}' "
            "when turn_id%50=21 then '{{\"p_wrong\": 0.5, \"verdict\": \"wrong\"}}' "
            "else concat('{{\"p_wrong\": 0.', cast(100 + turn_id%900 as string), ', \"verdict\": \"', judge_verdict, "
            "'\", \"reasons\": [\"r', cast(turn_id%3 as string), '\"]}}') end".replace("{{", "{").replace("}}", "}"),
        },
    ),
)

# raw agent answers, some of them broken
VIEWS["v_agent_raw"] = View(
    "v_decision",
    (
        {
            "turn_id": "id",
            "raw": "case when id%40=1 then '{\"reply_text\": \"\", \"claims\": {\"order_id\": \"1\", \"duplicate_charge\": false, "
            "\"refund_amount_paise\": 5, \"already_refunded\": false}, \"action\": {\"type\": \"no_action\", "
            "\"amount_paise\": 0, \"order_id\": \"1\"}}' "
            "when id%40=2 then 'no json at all' "
            "when id%40=3 then '{\"reply_text\": \"ok\", \"claims\": {\"order_id\": \"1\", \"duplicate_charge\": false, "
            "\"refund_amount_paise\": -5, \"already_refunded\": false}, \"action\": {\"type\": \"no_action\", "
            "\"amount_paise\": 0, \"order_id\": \"1\"}}' "
            "when id%40=4 then '{\"reply_text\": \"ok\", \"claims\": {\"order_id\": \"1\", \"duplicate_charge\": false, "
            "\"refund_amount_paise\": 5, \"already_refunded\": false}, \"action\": {\"type\": \"wire_money\", "
            "\"amount_paise\": 0, \"order_id\": \"1\"}}' "
            "when id%40=5 then '{\"reply_text\": \"ok\", \"action\": {\"type\": \"no_action\", "
            "\"amount_paise\": 0, \"order_id\": \"1\"}}' "
            "else concat('{\"reply_text\": \"done ', cast(id as string), '\", \"claims\": {\"order_id\": \"', cast(id as string), "
            "'\", \"duplicate_charge\": true, \"refund_amount_paise\": ', cast(id%1000 as string), ', \"already_refunded\": false}, "
            "\"action\": {\"type\": \"issue_refund\", \"amount_paise\": ', cast(id%1000 as string), ', \"order_id\": \"', "
            "cast(id as string), '\"}}') end",
        },
    ),
)

# outcome reports: one per event, several per decision, some for unknown decisions
VIEWS["v_outcome_event"] = View(
    "events",
    (
        {
            "event_id": "event_id",
            "e3": "(event_id - event_id%3)*7",
            "reported_us": "{us:ts}",
            "reported": "case when event_type='error' then 'wrong' when event_id%31=0 then 'unsure' else 'clean' end",
            "event_source": "case when event_id%29=0 then 'rumour' when event_type='signup' then 'human_override' "
            "when event_type='purchase' then 'record_verification' when event_type='error' then 'reversal' "
            "when event_type='click' then 'user_rework' else 'offline_judge' end",
            "processed_us": "case when event_id%17=0 then {us:ts} else null end",
        },
        {"decision_id": "cast((e3 - e3%4)/4 as bigint)"},
    ),
)

# reply lengths per action over time
VIEWS["v_length"] = View(
    "events",
    ({"id": "event_id", "action": "event_type", "ts_us": "{us:ts}", "length": "cast(floor(value*100) as bigint)"},),
)

# calibrator versions by year of the decision
VIEWS["v_version"] = View(
    "v_decision",
    (
        {
            "id": "id",
            "ts_us": "ts_us",
            "day": f"cast((ts_us - ts_us%{DAY})/{DAY} as bigint)",
            "calibrator_version": f"concat('cal-v', cast(1 + cast((ts_us - 788918400000000 - (ts_us - 788918400000000)%(365*{DAY}))"
            f"/(365*{DAY}) as bigint) as string))",
        },
    ),
)

# money lines of the system of record
VIEWS["v_charge"] = View(
    "lineitem",
    (
        {
            "charge_id": "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string))",
            "order_id": "l_orderkey",
            "amount_paise": "cast(l_quantity as bigint)*100",
            "charged_us": "{us:l_shipdate}",
        },
    ),
)
VIEWS["v_refund"] = View(
    "lineitem",
    (
        {
            "refund_id": "concat('r', cast(l_orderkey as string))",
            "order_id": "l_orderkey",
            "amount_paise": "cast(l_quantity as bigint)*100",
            "status": "'SETTLED'",
            "issued_us": "{us:l_shipdate}",
            "l_returnflag": "l_returnflag",
            "l_linenumber": "l_linenumber",
        },
    ),
    where="l_returnflag='R' and l_linenumber=1",
)
VIEWS["v_feature"] = View(
    "lineitem",
    (
        {
            "row_us": "{us:l_shipdate}",
            "row_key": "l_orderkey*100 + l_linenumber",
            "part": "l_partkey",
            "supp": "l_suppkey",
            "quantity": "l_quantity",
            "price": "l_extendedprice",
            "discount": "l_discount",
            "tax": "case when l_partkey%20=0 then null else l_tax end",
        },
    ),
)
# documents as replies: words are invented, so the lexicon is a parameter
VIEWS["v_doc"] = View("documents", ({"doc_id": "doc_id", "text": "text", "lang": "lang"},))

DUCK_VIEWS: dict[str, str] = {name: view.duck() for name, view in VIEWS.items()}

# --- views that need a join -------------------------------------------------------
DUCK_VIEWS["v_order"] = f"""
select o_orderkey as order_id, coalesce(m.amount, 0) as amount_paise,
  case o_orderstatus when 'P' then 'CANCELLED' when 'O' then 'SHIPPED' else 'DELIVERED' end as status,
  epoch_us(o_orderdate) as placed_us,
  case when o_orderstatus='P' then null else m.delivered end as delivered_us
from orders left join (
  select l_orderkey, max(cast(l_quantity as bigint))*100 as amount, max(epoch_us(l_shipdate)) as delivered
  from lineitem group by 1) m on l_orderkey = o_orderkey"""

DUCK_VIEWS["v_claim"] = f"""
select id as turn_id, case when id%41=0 then -id else o.order_id end as true_order,
  case when id%13=0 then null when id%97=0 then -id else id end as claim_order,
  case when id%13=0 then null else id%3=0 end as claim_dup,
  case when id%13=0 then null else o.amount_paise + case when id%11=0 then 500 else 0 end end as claim_amount,
  case when id%13=0 then null else id%4=0 end as claim_refunded,
  case when id%5=0 then 'no_action' else 'issue_refund' end as act_type,
  case when id%19=0 then o.amount_paise + 100 else o.amount_paise end as act_amount,
  coalesce(o.delivered_us, 0) + (id%60)*{DAY} as ts_us
from v_decision join v_order o on o.order_id = id"""

DUCK_VIEWS["v_reply"] = """
select a.conv_id, a.turn, a.text as reply, b1.text as chunk1, b2.text as chunk2
from conversations a
join benchmark b1 on b1.item_id = a.conv_id % (select count(*) from benchmark)
join benchmark b2 on b2.item_id = (select count(*) - 1 from benchmark) - a.conv_id % (select count(*) from benchmark)
where a.role = 'assistant'"""


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return VIEWS[name].spark(spark, sf)


def order_table(spark: SparkSession, sf: str) -> DataFrame:
    per_order = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(
            (F.max(F.col("l_quantity").cast("bigint")) * 100).alias("amount_paise"),
            F.max("l_shipdate").alias("_delivered"),
        )
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "P", "CANCELLED")
        .when(F.col("o_orderstatus") == "O", "SHIPPED")
        .otherwise("DELIVERED")
        .alias("status"),
        F.expr(us_of("o_orderdate")).alias("placed_us"),
    )
    return orders.join(per_order, "order_id", "left").select(
        "order_id",
        F.coalesce("amount_paise", F.lit(0)).alias("amount_paise"),
        "status",
        "placed_us",
        F.when(F.col("status") != "CANCELLED", F.expr(us_of("_delivered"))).alias("delivered_us"),
    )


def claim_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with the agent's typed claims and proposed action about one order each."""
    turns = view(spark, sf, "v_decision").select(F.col("id").alias("turn_id"))
    order = order_table(spark, sf).select(F.col("order_id").alias("true_order"), "amount_paise", "delivered_us")
    t = F.col("turn_id")
    claim = F.struct(
        # ids as text, as agents write them; some are no numbers
        F.when(t % 97 == 0, F.concat(F.lit("ord_"), t.cast("string"))).otherwise(t.cast("string")).alias("order_id"),
        (t % 3 == 0).alias("duplicate_charge"),
        (F.col("amount_paise") + F.when(t % 11 == 0, 500).otherwise(0)).alias("refund_amount_paise"),
        (t % 4 == 0).alias("already_refunded"),
    )
    return turns.join(order, turns.turn_id == order.true_order).select(
        "turn_id",
        F.when(t % 41 == 0, -t).otherwise(F.col("true_order")).alias("true_order"),
        F.when(t % 13 != 0, claim).alias("claims"),
        F.struct(
            F.when(t % 5 == 0, "no_action").otherwise("issue_refund").alias("type"),
            F.when(t % 19 == 0, F.col("amount_paise") + 100).otherwise(F.col("amount_paise")).alias("amount_paise"),
        ).alias("action"),
        (F.coalesce("delivered_us", F.lit(0)) + (t % 60) * F.lit(DAY)).alias("ts_us"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns with the two passages that were retrieved for them."""
    bench = table(spark, sf, "benchmark")
    n = bench.count()
    first = bench.select(F.col("item_id").alias("_i1"), F.col("text").alias("_c1"))
    second = bench.select(F.col("item_id").alias("_i2"), F.col("text").alias("_c2"))
    talk = table(spark, sf, "conversations").filter("role = 'assistant'")
    return (
        talk.join(first, F.col("conv_id") % n == F.col("_i1"))
        .join(second, (n - 1) - F.col("conv_id") % n == F.col("_i2"))
        .select("conv_id", "turn", F.col("text").alias("reply"), F.array("_c1", "_c2").alias("chunks"))
    )

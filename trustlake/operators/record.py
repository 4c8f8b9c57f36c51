"""Checks of an agent's claims against the system of record.

Order, charge and refund tables are joined once per order, not once per claim.
``order``: order_id, amount_paise, status, delivered_us. ``charge``: charge_id,
order_id, amount_paise, charged_us. ``refund``: refund_id, order_id,
amount_paise, status, issued_us.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake.config import DAY_US, SETTINGS
from trustlake.functions.time import utc_date

Verifier = Callable[[Column], Column]

# claim key -> condition on the claimed value and the joined record columns
VERIFIERS: dict[str, Verifier] = {
    "order_id": lambda claimed: F.col("order_found"),
    "duplicate_charge": lambda claimed: claimed == (F.col("same_charges") > 1),
    "refund_amount_paise": lambda claimed: F.col("order_found") & (claimed == F.col("order_amount")),
    "already_refunded": lambda claimed: claimed == F.col("refunded"),
}


def register_verifier(key: str, check: Verifier) -> None:
    """Add a check for a claim field; ``check`` maps the claimed value to a boolean column."""
    VERIFIERS[key] = check


def record_facts(order: DataFrame, charge: DataFrame, refund: DataFrame) -> DataFrame:
    """One row per order id known to the order or the refund table.

    Charges are counted per (order, amount) before the join, so an order with
    very many charges is folded on the map side.
    """
    charges = charge.groupBy("order_id", "amount_paise").agg(F.count("*").alias("same_charges"))
    refunds = refund.select("order_id").distinct().withColumn("refunded", F.lit(True))
    return (
        order.select("order_id", "amount_paise", "status", "delivered_us")
        .join(charges, ["order_id", "amount_paise"], "left")
        .withColumn("order_found", F.lit(True))
        .join(refunds, "order_id", "full")
        .select(
            "order_id",
            F.coalesce("order_found", F.lit(False)).alias("order_found"),
            F.col("amount_paise").alias("order_amount"),
            F.upper("status").alias("status"),
            "delivered_us",
            F.coalesce("same_charges", F.lit(0)).alias("same_charges"),
            F.coalesce("refunded", F.lit(False)).alias("refunded"),
        )
    )


def _with_facts(turns: DataFrame, order_id: Column, facts: DataFrame) -> DataFrame:
    """Left join of the record; an order that very many turns name skews only the turn side,
    which adaptive execution splits.

    Where a claimed id and the record's are of different types both are compared as text,
    so an id that is no number matches nothing instead of ending the job.
    """
    renamed = facts.withColumnRenamed("order_id", "_fact_order")
    known = F.col("_fact_order")
    if turns.select(order_id.alias("_o")).schema["_o"].dataType != facts.schema["order_id"].dataType:
        order_id, known = order_id.cast("string"), known.cast("string")
    joined = turns.join(renamed, order_id == known, "left")
    return (
        joined.withColumn("order_found", F.coalesce("order_found", F.lit(False)))
        .withColumn("same_charges", F.coalesce("same_charges", F.lit(0)))
        .withColumn("refunded", F.coalesce("refunded", F.lit(False)))
    )


def verify_claims(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``verify_fail_frac`` and ``verify_n_claims`` for the struct column ``claims``.

    A claim without a registered check counts nowhere; one that cannot be
    evaluated counts as failed. Without checkable claims the pair is (0.0, 0).
    """
    fields = turns.schema["claims"].dataType.fieldNames()
    results = [
        F.when(F.col("claims")[key].isNotNull(), F.coalesce(check(F.col("claims")[key]), F.lit(False)))
        for key, check in VERIFIERS.items()
        if key in fields
    ]
    joined = _with_facts(turns, F.col("claims.order_id"), facts)
    checked = joined.withColumn("_checks", F.array_compact(F.array(*results)))
    n = F.size("_checks")
    failed = F.size(F.filter("_checks", lambda ok: ~ok))
    return (
        checked.withColumn("verify_n_claims", n)
        .withColumn("verify_fail_frac", F.when(n == 0, F.lit(0.0)).otherwise(failed / n))
        .select(*turns.columns, "verify_fail_frac", "verify_n_claims")
    )


def gather_facts(turns: DataFrame, order_id: Column, facts: DataFrame) -> DataFrame:
    """Add the struct ``facts``: what the record says about the turn's order at ``ts_us``.

    Every turn stays; without an order on record ``facts`` is null.
    """
    joined = _with_facts(turns, order_id, facts)
    inside = (F.col("ts_us") - F.col("delivered_us")) <= SETTINGS.refund_window_days * DAY_US
    delivered = F.col("delivered_us").isNotNull() & (F.col("delivered_us") != 0)
    record = F.struct(
        F.col("_fact_order").alias("order_id"),
        F.col("order_amount").alias("amount_paise"),
        "status",
        (F.col("same_charges") > 1).alias("has_duplicate"),
        F.col("refunded").alias("already_refunded"),
        (delivered & F.coalesce(inside, F.lit(False))).alias("within_window"),
    )
    return joined.withColumn("facts", F.when(F.col("order_found"), record)).select(*turns.columns, "facts")


def label_outcomes(turns: DataFrame) -> DataFrame:
    """Add ``outcome`` and ``outcome_reasons`` from ``claims``, ``action`` and ``facts``.

    A turn without facts cannot be judged: its outcome is null, the reason ``order_not_on_record``.
    """
    claim, act, fact = F.col("claims"), F.col("action"), F.col("facts")
    issuing = (act["type"] == "issue_refund") & (act["amount_paise"] > 0)
    # fixed values: names of the faults
    faults = [
        (fact.isNull(), "order_not_on_record"),
        (claim["order_id"].cast("string") != fact["order_id"].cast("string"), "wrong_order"),
        (claim["duplicate_charge"] & ~fact["has_duplicate"], "claimed_duplicate_that_does_not_exist"),
        (claim["already_refunded"] != fact["already_refunded"], "misreported_refund_status"),
        (issuing & fact["already_refunded"], "double_refund"),
        (issuing & ~fact["within_window"], "outside_refund_window"),
        (issuing & (fact["status"] == "CANCELLED"), "refunded_cancelled_order"),
        (issuing & (act["amount_paise"] > fact["amount_paise"]), "over_refund"),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in faults]))
    return turns.withColumn("outcome_reasons", reasons).withColumn(
        "outcome", F.when(fact.isNotNull(), F.when(F.size("outcome_reasons") > 0, "wrong").otherwise("clean"))
    )


def order_pools(order: DataFrame, charge: DataFrame, refund: DataFrame) -> DataFrame:
    """Class of every delivered order: refunded, duplicate, near_duplicate or plain.

    Cancelled orders have no delivery date and no class; orders that are neither
    delivered nor refunded are left out as well.
    """
    per_amount = charge.groupBy("order_id", "amount_paise").agg(F.count("*").alias("same"))
    totals = charge.groupBy("order_id").agg(F.count("*").alias("charges"))
    refunds = refund.select("order_id").distinct().withColumn("_refunded", F.lit(True))
    pool = (
        F.when(F.col("_refunded"), "refunded")
        .when(F.upper("status") != "DELIVERED", F.lit(None))
        .when(F.col("same") > 1, "duplicate")
        .when((F.col("charges") > 1) & (F.col("same") == 1), "near_duplicate")
        .otherwise("plain")
    )
    return (
        order.filter(F.col("delivered_us").isNotNull())
        .join(totals, "order_id", "left")
        .join(per_amount, ["order_id", "amount_paise"], "left")
        .join(refunds, "order_id", "left")
        .withColumn("pool", pool)
        .filter(F.col("pool").isNotNull())
        .select("order_id", "amount_paise", "status", "delivered_us", "pool")
    )


def pool_intents(pools: DataFrame) -> DataFrame:
    """One row per (order, intent it can serve)."""
    plain = ["non_duplicate_misread", "out_of_policy_age", "adversarial"]
    served = (
        F.when(F.col("pool") == "refunded", F.array(F.lit("already_refunded")))
        .when(F.col("pool") == "duplicate", F.array(F.lit("legit_duplicate")))
        .when(F.col("pool") == "near_duplicate", F.array(F.lit("ambiguous")))
        .otherwise(F.array(*[F.lit(i) for i in plain]))
    )
    return pools.withColumn("intent", F.explode(served))


def _date(us: Column) -> Column:
    """The UTC date as yyyy-MM-dd, whatever the session's time zone."""
    return F.coalesce(utc_date(us).cast("string"), F.lit("(none)"))


def ledger_lines(charge: DataFrame, refund: DataFrame) -> DataFrame:
    """One row per distinct ledger line of an order, with its number of repetitions ``n``.

    Equal lines are folded before the shuffle, so an order with very many charges
    stays small.
    """
    # fixed values: the line formats
    charges = charge.select(
        "order_id", F.lit("charge").alias("section"), F.col("charged_us").alias("at_us"),
        F.concat(F.lit("      - "), F.col("amount_paise").cast("string"), F.lit(" paise, charged_at "),
                 _date(F.col("charged_us"))).alias("line"),
    )
    refunds = refund.select(
        "order_id", F.lit("refund").alias("section"), F.col("issued_us").alias("at_us"),
        F.concat(F.lit("      - "), F.col("amount_paise").cast("string"), F.lit(" paise, "), F.col("status"),
                 F.lit(", issued_at "), _date(F.col("issued_us"))).alias("line"),
    )
    return charges.unionByName(refunds).groupBy("order_id", "section", "at_us", "line").agg(F.count("*").alias("n"))


def render_context(turns: DataFrame, order_id: Column, order: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``context``: policy bullets, date, order record and ledger lines as one text.

    Every turn stays; one without an order on record says so in the place of the record. ``turns`` carries ``chunks`` (array of policy passages) and ``ts_us``.
    """
    def section(name: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("at_us", "line", "n"))))
        repeated = F.transform(picked, lambda r: F.array_join(F.array_repeat(r["line"], r["n"].cast("int")), "\n"))
        return F.when(F.size(repeated) == 0, F.lit(f"      - (no {name}s on record)")).otherwise(
            F.array_join(repeated, "\n")
        )

    asked = turns.select(order_id.alias("order_id")).distinct()
    ledger = (
        lines.join(asked, "order_id", "left_semi")
        .groupBy("order_id")
        .agg(section("charge").alias("_charges"), section("refund").alias("_refunds"))
    )
    record = order.join(ledger, "order_id", "left").withColumnRenamed("order_id", "_o")
    none = [F.lit(f"      - (no {name}s on record)") for name in ("charge", "refund")]
    # fixed values: the layout of the context text
    found = F.concat(
        F.lit("  id:                "), F.col("_o").cast("string"),
        F.lit("\n  amount_paise:      "), F.col("amount_paise").cast("string"),
        F.lit("\n  status:            "), F.col("status"),
        F.lit("\n  delivered_at:      "),
        F.when(F.col("delivered_us").isNull(), "never delivered (cancelled)").otherwise(_date(F.col("delivered_us"))),
        F.lit("\n  charge ledger:\n"), F.coalesce("_charges", none[0]),
        F.lit("\n  refund ledger:\n"), F.coalesce("_refunds", none[1]), F.lit("\n"),
    )
    text = F.concat(
        F.lit("Retrieved policy:\n"),
        F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("- "), c)), "\n"),
        F.lit("\n\nToday's date is "), _date(F.col("ts_us")),
        F.lit(".\n\nOrder record:\n"), F.when(F.col("_o").isNull(), "  (no order on record)\n").otherwise(found),
    )
    return (
        turns.join(record.select("_o", "amount_paise", "status", "delivered_us", "_charges", "_refunds"),
                   order_id == F.col("_o"), "left")
        .withColumn("context", text)
        .select(*turns.columns, "context")
    )

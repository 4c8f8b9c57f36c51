"""Claims against the record, labels, and point-in-time features."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trustlake.config import CAN_BE_UNAVAILABLE, CAPABILITY_TIERS, FEATURE_NAMES
from trustlake.operators import features, record

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def tables(spark):
    order = spark.createDataFrame(
        [(1, 1000, "DELIVERED", 10 * DAY), (2, 2000, "delivered", 10 * DAY), (3, 500, "CANCELLED", None),
         (4, 700, "SHIPPED", 10 * DAY), (5, 900, "DELIVERED", 10 * DAY)],
        "order_id bigint, amount_paise bigint, status string, delivered_us bigint",
    )
    charge = spark.createDataFrame(
        [("a", 1, 1000, DAY), ("b", 1, 1000, DAY), ("c", 2, 2000, DAY), ("d", 2, 1999, 2 * DAY), ("e", 5, 900, DAY)],
        "charge_id string, order_id bigint, amount_paise bigint, charged_us bigint",
    )
    refund = spark.createDataFrame(
        [("r", 4, 700, "SETTLED", 11 * DAY), ("s", 99, 1, "SETTLED", 11 * DAY)],
        "refund_id string, order_id bigint, amount_paise bigint, status string, issued_us bigint",
    )
    return order, charge, refund


CLAIMS = "turn_id int, claims struct<order_id:bigint,duplicate_charge:boolean,refund_amount_paise:bigint,already_refunded:boolean,mood:string>"


def test_verify_claims(spark, tables):
    facts = record.record_facts(*tables)
    turns = spark.createDataFrame(
        [
            (1, (1, True, 1000, False, "x")),       # all hold
            (2, (2, True, 2000, False, None)),      # no duplicate at the order amount
            (3, (77, False, 10, False, None)),      # unknown order: exists and amount fail
            (4, (99, None, None, True, None)),      # refund known, order unknown
            (5, (None, None, None, None, "happy")), # only an unregistered claim
            (6, None),                              # no claims at all
        ],
        CLAIMS,
    )
    got = {r["turn_id"]: (r["verify_fail_frac"], r["verify_n_claims"]) for r in record.verify_claims(turns, facts).collect()}
    assert got == {1: (0.0, 4), 2: (0.25, 4), 3: (0.5, 4), 4: (0.5, 2), 5: (0.0, 0), 6: (0.0, 0)}


def test_registered_verifier_is_used(spark, tables):
    record.register_verifier("mood", lambda claimed: claimed == "x")
    try:
        turns = spark.createDataFrame([(1, (1, True, 1000, False, "y"))], CLAIMS)
        row = record.verify_claims(turns, record.record_facts(*tables)).first()
        assert (row["verify_fail_frac"], row["verify_n_claims"]) == (0.2, 5)
    finally:
        del record.VERIFIERS["mood"]


def label(spark, tables, order_id, claims, action, ts):
    turns = spark.createDataFrame(
        [(1, order_id, claims, action, ts)],
        "turn_id int, oid bigint, claims struct<order_id:bigint,duplicate_charge:boolean,already_refunded:boolean>, "
        "action struct<type:string,amount_paise:bigint>, ts_us bigint",
    )
    out = record.label_outcomes(record.gather_facts(turns, F.col("oid"), record.record_facts(*tables)))
    row = out.first()
    return row["outcome"], row["outcome_reasons"]


def test_labels(spark, tables):
    refund = ("issue_refund", 1000)
    assert label(spark, tables, 1, (1, True, False), refund, 20 * DAY) == ("clean", [])
    assert label(spark, tables, 1, (1, True, False), refund, 41 * DAY) == ("wrong", ["outside_refund_window"])
    assert label(spark, tables, 1, (1, True, False), ("no_action", 1000), 41 * DAY) == ("clean", [])
    assert label(spark, tables, 3, (3, False, False), ("issue_refund", 500), 20 * DAY) == (
        "wrong", ["outside_refund_window", "refunded_cancelled_order"])
    assert label(spark, tables, 4, (5, True, False), ("issue_refund", 800), 20 * DAY) == (
        "wrong",
        ["wrong_order", "claimed_duplicate_that_does_not_exist", "misreported_refund_status", "double_refund", "over_refund"],
    )


def test_pools(spark, tables):
    got = {r["order_id"]: r["pool"] for r in record.order_pools(*tables).collect()}
    assert got == {1: "duplicate", 2: "near_duplicate", 4: "refunded", 5: "plain"}
    intents = record.pool_intents(record.order_pools(*tables))
    assert intents.filter("order_id = 5").count() == 3


def test_context_keeps_repeated_lines(spark, tables):
    order, charge, refund = tables
    turns = spark.createDataFrame([(1, 1, 15 * DAY, ["be kind"])], "turn_id int, oid bigint, ts_us bigint, chunks array<string>")
    text = record.render_context(turns, F.col("oid"), order, record.ledger_lines(charge, refund)).first()["context"]
    assert text.count("      - 1000 paise, charged_at 1970-01-02") == 2
    assert "      - (no refunds on record)" in text and "Today's date is 1970-01-16." in text
    assert text.startswith("Retrieved policy:\n- be kind\n\n")


# --- features ---------------------------------------------------------------------


def lengths(spark, rows):
    df = spark.createDataFrame(rows, "id int, action string, ts_us bigint, length int")
    return {r["id"]: r["length_z"] for r in features.length_z(df, "action", "ts_us", "id", "length").collect()}


def test_length_z_needs_thirty_earlier_rows(spark):
    rows = [(i, "a", i, 100 + i % 7) for i in range(31)]
    got = lengths(spark, rows)
    assert all(got[i] is None for i in range(30)) and got[30] is not None


def test_length_z_without_spread_is_zero(spark):
    assert lengths(spark, [(i, "a", i, 50) for i in range(40)])[39] == 0.0


def test_length_z_sees_the_past_only(spark):
    rows = [(i, "a", i, 100 + (i % 3)) for i in range(40)] + [(40, "a", 40, 140)]
    future = [(41 + i, "a", 41 + i, 400 + i) for i in range(400)]
    honest, crowded = lengths(spark, rows)[40], lengths(spark, rows + future)[40]
    assert honest == crowded > 0


def test_length_z_brute_force_with_peers_and_a_hot_action(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.7 else "cold", rng.choice([7, 7, 7, rng.randrange(60)]), rng.randrange(1, 400))
            for i in range(1500)]
    got = lengths(spark, rows)
    for i, action, ts, n in rows:
        past = [x for _, a, t, x in rows if a == action and t < ts]
        if len(past) < 30:
            assert got[i] is None
            continue
        mu = sum(past) / len(past)
        sigma = math.sqrt(sum((x - mu) ** 2 for x in past) / len(past))
        assert got[i] == pytest.approx((n - mu) / sigma, abs=1e-9)


def test_missing_semantics(spark):
    df = spark.createDataFrame(
        [(1, 0.25, None, None, "not_supported"), (2, None, 0.9, 1.0, "unavailable")],
        "id int, pii_score double, judge_p_wrong double, length_z double, length_z_missing string",
    )
    out = features.assemble_features(df, F.lit(5), "none", not_supported=("judge_p_wrong",)).orderBy("id").collect()
    a, b = out[0]["features"], out[1]["features"]
    assert (a["pii_score"], a["pii_score_unavailable"]) == (0.25, 0)
    assert (b["pii_score"], b["pii_score_unavailable"]) == (None, 1)
    assert (a["judge_p_wrong"], a["judge_p_wrong_unavailable"]) == (None, 0)
    assert (a["length_z"], a["length_z_unavailable"]) == (None, 0)
    assert (b["length_z"], b["length_z_unavailable"]) == (None, 1)
    assert a["logprob_mean"] is None and "logprob_mean_unavailable" not in a.asDict()
    assert a["as_of"] == 5 and a["capability_tier"] == "none"
    names = [n for n in a.asDict() if n in FEATURE_NAMES]
    assert tuple(names) == FEATURE_NAMES


def test_unknown_tier_is_refused(spark):
    with pytest.raises(ValueError):
        features.assemble_features(spark.range(1), F.lit(1), "half")


def test_vector_carries_flags(spark):
    df = spark.createDataFrame([(0.25, None)], "verify_fail_frac double, hedge_density double")
    out = features.assemble_features(df, F.lit(1), "full")
    fields = out.schema["features"].dataType.fieldNames()
    names = ["verify_fail_frac", "hedge_density", "pii_score"]
    vector = out.select(features.to_vector(F.col("features"), names, fields).alias("v")).first()["v"]
    assert vector == [0.25, 0.0, 0.0, 0.0, 1.0]
    assert features.vector_names(names) == [
        "verify_fail_frac", "verify_fail_frac_unavailable", "hedge_density", "pii_score", "pii_score_unavailable"]
    assert len(features.vector_names(FEATURE_NAMES)) == 15 + len(CAN_BE_UNAVAILABLE)
    assert features.model_features("none", False) == [n for n in CAPABILITY_TIERS["none"] if n != "judge_p_wrong"]


def test_build_features_end_to_end(spark, tables):
    turns = spark.createDataFrame(
        [(i, i * 1000, "issue_refund", f"Maybe {'x' * (i % 5)} refund. Call 9876543210", "hi", ["refund call"],
          (1, True, 1000, False, None)) for i in range(35)],
        "turn_id int, ts_us bigint, action string, reply string, prompt string, chunks array<string>, "
        "claims struct<order_id:bigint,duplicate_charge:boolean,refund_amount_paise:bigint,already_refunded:boolean,mood:string>",
    )
    out = features.build_features(turns, record.record_facts(*tables)).orderBy("turn_id").collect()
    assert len(out) == 35
    last = out[-1]["features"]
    assert last["verify_n_claims"] == 4.0 and last["pii_score"] == 1.0 and last["hedge_density"] > 0
    assert last["length_z"] is not None and out[0]["features"]["length_z_unavailable"] == 1
    assert last["injection_score_unavailable"] == 1 and last["judge_p_wrong_unavailable"] == 0

"""Breaker, recovery, recomputation, borrowing, closing of outcomes."""

import pytest
from pyspark.sql import functions as F

from trustlake.operators import gate, outcomes, trust

KEY = ("a", "issue_refund", "10k-50k", "f")
SCHEMA = (
    "id bigint, ts_us bigint, agent_id string, action string, band string, fingerprint string, outcome string, "
    "source string, outcome_us bigint"
)


def history(spark, labels, key=KEY, start=0):
    rows = [(start + i, i, *key, o, "record_verification", None) for i, o in enumerate(labels)]
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, labels, prior=None):
    tail = trust.record_tail(history(spark, labels))
    old = None
    if prior is not None:
        old = spark.createDataFrame(
            [(*KEY, prior, 0)],
            "agent_id string, action string, band string, fingerprint string, tripped_at bigint, clean_since_trip bigint",
        )
    return trust.breaker_state(tail, 500, old).first()


C, W, OPEN = ["clean"], ["wrong"], [None]


@pytest.mark.parametrize(
    "labels,trips",
    [(C * 97 + W * 2, False), (C * 97 + W * 3, True), (W * 3 + C * 150, False), (W * 3 + C * 50 + OPEN * 60, False),
     (W * 3 + C * 40 + OPEN * 57, True)],
)
def test_trip(spark, labels, trips):
    row = state(spark, labels)
    assert (row["tripped_at"] == 500) is trips
    assert row["clean_since_trip"] == 0


@pytest.mark.parametrize("clean,open_rows,clears", [(49, 0, False), (50, 0, True), (50, 30, True), (49, 30, False)])
def test_recovery_needs_clean_decisions(spark, clean, open_rows, clears):
    row = state(spark, C * 10 + W + C * clean + OPEN * open_rows, prior=100)
    assert (row["tripped_at"] is None) is clears
    assert row["clean_since_trip"] == (0 if clears else clean)


def test_recompute_blocks_after_three_failures(spark):
    good = trust.recompute_trust(history(spark, C * 400), 1000).first()
    assert good["state"] == "autonomous" and good["budget"] == pytest.approx(681.95, abs=0.01)
    assert good["n_own_raw"] == 400 and good["ceiling"] == pytest.approx(720.0)
    bad = trust.recompute_trust(history(spark, C * 400 + W * 3), 1000).first()
    assert bad["state"] == "supervised" and bad["budget"] == 0.0 and bad["tripped_at"] == 1000


def test_recompute_leaves_out_what_has_no_price(spark):
    rows = history(spark, C * 40)
    for i, key in enumerate([("a", "no_action", "unpriced", "f"), ("a", "issue_refund", "over_limit", "f"),
                             ("a", "wire_money", "0-2k", "f")]):
        rows = rows.unionByName(history(spark, C * 40, key, 1000 * (i + 1)))
    got = trust.recompute_trust(rows, 1000).collect()
    assert [(r["action"], r["band"]) for r in got] == [("issue_refund", "10k-50k")]


def test_borrowing_does_not_satisfy_the_sample_floor(spark):
    small = history(spark, C * 4000, ("a", "issue_refund", "0-2k", "f"))
    big = history(spark, C * 2, ("a", "issue_refund", "50k+", "f"), 10_000)
    rows = {r["band"]: r for r in trust.recompute_trust(small.unionByName(big), 5000, borrow=True).collect()}
    assert rows["50k+"]["budget"] == 0.0 and rows["50k+"]["p_lo"] > 0.9


def test_borrow_weights(spark):
    counts = spark.createDataFrame(
        [("a", "x", "f", "0-2k", 10.0, 10.0), ("a", "x", "f", "10k-50k", 5.0, 8.0), ("b", "x", "f", "0-2k", 1.0, 1.0)],
        "agent_id string, action string, fingerprint string, band string, n_clean double, n_total double",
    )
    got = {(r["agent_id"], r["band"]): (r["k_eff"], r["n_eff"]) for r in trust.borrow_strength(counts).collect()}
    assert got[("a", "0-2k")] == pytest.approx((10 + 0.1 * 0.25 * 5, 10 + 0.1 * 0.25 * 8))
    assert got[("a", "10k-50k")] == pytest.approx((5 + 0.025 * 10, 8 + 0.025 * 10))
    assert got[("b", "0-2k")] == (1.0, 1.0) and len(got) == 3


def test_upsert_keeps_old_and_replaces_new(spark):
    ddl = "agent_id string, action string, band string, fingerprint string, budget double, note string"
    old = spark.createDataFrame([("a", "x", "b1", "f", 1.0, "old"), ("a", "x", "b2", "f", 2.0, "old")], ddl)
    new = spark.createDataFrame([("a", "x", "b2", "f", None, "new"), ("a", "x", "b3", "f", 3.0, "new")], ddl)
    got = {r["band"]: (r["budget"], r["note"]) for r in trust.upsert_trust(old, new).collect()}
    assert got == {"b1": (1.0, "old"), "b2": (None, "new"), "b3": (3.0, "new")}


def test_replay_uses_earlier_labels_only(spark):
    n = 60
    rows = [(i, i, "a", "issue_refund", "10k-50k", 20000.0, 0.01, "clean") for i in range(n)]
    df = spark.createDataFrame(
        rows, "id bigint, ts_us bigint, agent_id string, action string, band string, amount double, p_wrong double, outcome string"
    )
    out = gate.replay_gate(df).orderBy("id").collect()
    assert [r["own_total"] for r in out] == list(range(n))
    assert all(r["verdict"] == "escalate" for r in out[:30]) and out[59]["verdict"] == "act"


EVENTS = "event_id bigint, decision_id bigint, reported_us bigint, outcome string, source string, weight double, processed_us bigint"


@pytest.fixture()
def closing(spark):
    events = spark.createDataFrame(
        [(1, 7, 150, "wrong", "user_rework", 0.3, None), (2, 7, 160, "clean", "human_override", 1.0, None),
         (3, 8, 100, "wrong", "reversal", 0.9, None), (4, 9, 100, "wrong", "reversal", 0.9, 120)],
        EVENTS,
    )
    decisions = spark.createDataFrame(
        [(7, 100, None, 200, None, None), (8, 100, "clean", 150, "reversal", 120), (9, 100, None, 150, None, None)],
        "id bigint, ts_us bigint, outcome string, horizon_us bigint, source string, outcome_us bigint",
    )
    return events, decisions


def test_nothing_closes_before_the_horizon(closing):
    assert outcomes.resolve_outcomes(*closing, 199).count() == 0


def test_heaviest_event_wins_and_all_are_marked(closing):
    events, decisions = closing
    closed = outcomes.resolve_outcomes(events, decisions, 250)
    assert [tuple(r) for r in closed.collect()] == [(7, "clean", "human_override", 160)]
    marked = {r["event_id"]: r["processed_us"] for r in outcomes.mark_processed(events, closed, 250).collect()}
    assert marked == {1: 250, 2: 250, 3: None, 4: 120}
    after = {r["id"]: (r["outcome"], r["outcome_us"]) for r in outcomes.apply_outcomes(decisions, closed).collect()}
    assert after == {7: ("clean", 160), 8: ("clean", 120), 9: (None, None)}
    again = outcomes.resolve_outcomes(
        outcomes.mark_processed(events, closed, 250), outcomes.apply_outcomes(decisions, closed), 300)
    assert again.count() == 0


def test_strict_ignores_later_reports(closing):
    events, decisions = closing
    early = outcomes.resolve_outcomes(events.withColumn("reported_us", F.col("reported_us") + 200), decisions, 355, strict=True)
    assert [r["outcome"] for r in early.collect()] == ["wrong"]


def test_reports_are_filtered(spark):
    rows = spark.createDataFrame(
        [(1, "reversal", "wrong"), (2, "gossip", "wrong"), (3, "reversal", "maybe"), (4, None, "clean")],
        "event_id int, source string, outcome string",
    )
    ok, bad = outcomes.accept_reports(rows)
    assert [(r["event_id"], r["weight"]) for r in ok.collect()] == [(1, 0.9)]
    assert {r["event_id"]: r["reject_reason"] for r in bad.collect()} == {
        2: "unregistered_source", 3: "unregistered_outcome", 4: "unregistered_source"}

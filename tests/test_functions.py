"""Golden values of the ledger, the gate and the ladder."""

import pytest
from pyspark.sql import functions as F

from trustlake.config import BANDS, SETTINGS
from trustlake.functions import decision as dec
from trustlake.functions import ledger, pricing
from trustlake.operators import gate


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


WILSON = [
    (0, 0, 0.0), (3, 3, 0.4385), (4, 4, 0.5101), (20, 20, 0.8389), (50, 50, 0.9286),
    (100, 100, 0.9630), (400, 400, 0.9905), (11398, 11412, 0.9979),
]


def test_wilson_golden(spark):
    df = spark.createDataFrame(WILSON, "clean int, total int, want double")
    for row in df.withColumn("got", ledger.wilson_lower(F.col("clean"), F.col("total"))).collect():
        assert row["got"] == pytest.approx(row["want"], abs=5e-5)


def test_wilson_is_monotone_and_bounded(spark):
    df = spark.range(1, 400).withColumn("lo", ledger.wilson(F.col("id"), F.col("id"))[0]).withColumn(
        "hi", ledger.wilson(F.col("id"), F.col("id"))[1]
    )
    rows = df.orderBy("id").collect()
    assert all(a["lo"] < b["lo"] for a, b in zip(rows, rows[1:]))
    assert all(0 <= r["lo"] <= r["hi"] <= 1 for r in rows)


def test_ceilings(spark):
    df = spark.createDataFrame([(b, "issue_refund") for b, _, _ in BANDS], "band string, action string")
    rows = pricing.with_action_terms(df).select("band", pricing.ceiling(F.col("band")).alias("c")).collect()
    got = {r["band"]: r["c"] for r in rows}
    assert got == pytest.approx({"0-2k": 28.80, "2k-10k": 144.0, "10k-50k": 720.0, "50k+": 2880.0})


@pytest.mark.parametrize("n,want", [(29, 0.0), (30, 265.93), (50, 434.60), (100, 572.02), (400, 681.95), (1000, 704.69)])
def test_budget_curve(spark, n, want):
    got = one(spark, ledger.budget(ledger.wilson_lower(F.lit(n), F.lit(n)), F.lit(720.0), F.lit(n)))
    assert got == pytest.approx(want, abs=0.01)


def test_exposure_prices_and_missing_payload(spark):
    df = spark.createDataFrame(
        [(1, "issue_refund", 1240.0, None), (2, "send_bulk_email", 0.0, "100"), (3, "send_bulk_email", 0.0, None),
         (4, "wire_money", 5.0, None), (5, "no_action", 900.0, None)],
        "id int, action string, amount double, recipients string",
    ).withColumn("band", F.lit("0-2k"))
    payload = F.create_map(F.lit("recipient_count"), F.col("recipients"))
    got = {r["id"]: r["exposure"] for r in gate.price(df, payload=payload).collect()}
    assert got[1] == pytest.approx(446.40)
    assert got[2] == pytest.approx(500 * 0.95 * 2.0 * 100)
    assert got[3] is None and got[4] is None and got[5] == 0.0


def test_band_edges(spark):
    rows = [(0.0, "0-2k"), (1999.99, "0-2k"), (2000.0, "2k-10k"), (10000.0, "10k-50k"), (50000.0, "50k+"),
            (200000.0, "50k+"), (200000.01, "over_limit"), (-1.0, None)]
    df = spark.createDataFrame(rows, "amount double, want string").withColumn("got", pricing.band_of(F.col("amount")))
    assert all(r["got"] == r["want"] for r in df.collect())


# amount, p, clean, total -> verdict at ceiling of the amount's band
CASES = [
    ("A", 1240.0, 0.008, 11398, 11412, "act"),
    ("B", 62000.0, 0.0015, 3, 3, "escalate"),
    ("C", 7000.0, 0.055, 200, 200, "check_harder"),
    ("C2", 7000.0, 0.015, 200, 200, "act"),
    ("D", 80.0, 0.5, 0, 0, "act"),
]


def test_worked_cases(spark):
    df = spark.createDataFrame(CASES, "name string, amount double, p double, clean int, total int, want string")
    df = df.withColumn("action", F.lit("issue_refund")).withColumn("band", pricing.band_of(F.col("amount")))
    priced = gate.price(df)
    budget = ledger.budget(ledger.wilson_lower(F.col("clean"), F.col("total")), F.col("ceiling"), F.col("total"))
    got = priced.withColumn("v", dec.decide(F.col("p"), F.col("exposure"), budget, F.lit(False))).collect()
    assert {r["name"]: r["v"] for r in got} == {r["name"]: r["want"] for r in got}


@pytest.mark.parametrize("p,want", [(0.050, "act"), (0.052, "check_harder"), (0.102, "check_harder"), (0.103, "escalate")])
def test_boundary_ladder(spark, p, want):
    assert one(spark, dec.decide(F.lit(p), F.lit(2520.0), F.lit(128.92), F.lit(False))) == want


def test_no_budget_means_no_close_call(spark):
    df = spark.range(1, 500).withColumn("p", F.col("id") / 500.0)
    got = df.select(dec.decide(F.col("p"), F.lit(5000.0), F.lit(0.0), F.lit(False)).alias("v")).distinct().collect()
    assert [r["v"] for r in got] == ["escalate"]


def test_missing_price_blocks_and_missing_probability_widens(spark):
    assert one(spark, dec.decide(F.lit(0.0), F.lit(None).cast("double"), F.lit(9.0), F.lit(False))) == "block"
    assert one(spark, dec.decide(F.lit(None).cast("double"), F.lit(100.0), F.lit(50.0), F.lit(False))) == "check_harder"
    assert one(spark, dec.decide(F.lit(0.0), F.lit(1.0), F.lit(9.0), F.lit(True))) == "block"


def test_invariants_fail_closed(spark):
    null = F.lit(None).cast("double")
    failed = dec.failed_invariants(null, F.lit(0.5), F.lit(0.49), F.lit(10.0), F.lit(5.0), F.lit(3), F.lit(2))
    assert one(spark, failed) == [
        "no_pii_egress", "no_prompt_injection", "within_authorisation_scope", "within_hard_amount_limit"
    ]
    fine = dec.failed_invariants(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), null)
    assert one(spark, fine) == []


RUNGS = [
    # pii, secret, injection, verify, localised, severity, side effect, rung
    (0.9, 0.0, 0.9, 1.0, True, 9.0, True, 2),
    (0.9, 0.0, 0.0, 0.0, False, 0.0, True, 5),
    (None, 0.0, 0.0, 0.0, False, 0.0, True, 5),
    (0.0, 0.0, 0.9, 1.0, True, 0.0, True, 6),
    (0.0, 0.0, 0.0, 0.5, False, 2.9, False, 3),
    (0.0, 0.0, 0.0, 0.5, False, 3.0, False, 5),
    (0.0, 0.0, 0.0, None, False, 1.0, False, 3),
    (0.0, 0.0, 0.0, 0.0, False, 2.9, True, 4),
    (0.0, 0.0, 0.0, 0.0, False, 3.0, True, 5),
    (0.0, 0.0, 0.0, 0.0, False, 1.9, False, 1),
    (0.0, 0.0, 0.0, 0.0, False, 2.0, False, 5),
]


def test_rungs(spark):
    df = spark.createDataFrame(
        RUNGS, "pii double, sec double, inj double, ver double, loc boolean, sev double, side boolean, want int"
    )
    rung = dec.select_rung(*[F.col(c) for c in ("pii", "sec", "inj", "ver", "loc", "sev", "side")])
    assert all(r["r"] == r["want"] for r in df.withColumn("r", rung).collect())
    assert one(spark, dec.rung_for_verdict(F.lit("block"), F.lit(4))) == 6
    assert one(spark, dec.rung_for_verdict(F.lit("act"), F.lit(4))) == 0


def test_regenerate_cap(spark):
    assert [one(spark, dec.regenerate_next(F.lit(a))) for a in (0, 1, 2, 3)] == [3, 3, 5, 5]


def test_evidence(spark):
    half = SETTINGS.age_halflife_days * 86_400_000_000
    weight = ledger.evidence_age_weight(F.lit("reversal"), F.lit(0), F.lit(1000), 1000 + half)
    assert one(spark, weight) == pytest.approx(0.45)
    assert one(spark, ledger.evidence_age_weight(F.lit("rumour"), F.lit(5), F.lit(5), 10)) == 0.0
    future = ledger.evidence_age_weight(F.lit("human_override"), F.lit(50), F.lit(5), 10)
    assert one(spark, future) == 1.0


def test_fingerprint_is_canonical(spark):
    import hashlib
    import json

    tools = [{"name": "refund", "args": 1}, {"name": "lookup"}]
    payload = json.dumps(
        {"model": "m-1", "prompt": hashlib.sha256(b"Hello \xc3\xa9").hexdigest(),
         "tools": sorted(tools, key=lambda t: t["name"]), "sensors": "sv", "calibrator": 'c"1'},
        sort_keys=True, separators=(",", ":"),
    )
    want = hashlib.sha256(payload.encode()).hexdigest()[:16]
    items = F.array(*[
        F.struct(F.lit(t["name"]).alias("name"), F.lit(json.dumps(t, sort_keys=True, separators=(",", ":"))).alias("json"))
        for t in tools
    ])
    assert one(spark, ledger.fingerprint(F.lit("m-1"), F.lit("Hello é"), items, F.lit("sv"), F.lit('c"1'))) == want


def test_sensor_version_column_equals_label(spark):
    from trustlake.config import SENSOR_STACK

    column = ledger.sensor_version_column(*[F.lit(SENSOR_STACK[k]) for k in ("tier0", "tier1", "tier2_model", "tier2_thinking")])
    assert one(spark, column) == ledger.sensor_version()
    assert ledger.sensor_version({**SENSOR_STACK, "tier2_thinking": "enabled"}) != ledger.sensor_version()


def test_platt_identity_and_clamp(spark):
    assert one(spark, ledger.platt(F.lit(0.3), 1.0, 0.0)) == pytest.approx(0.3)
    assert one(spark, ledger.platt(F.lit(0.0), 1.0, 0.0)) == pytest.approx(1e-6)


def test_reason_texts(spark):
    def reason(verdict, exposure):
        return one(spark, dec.decision_reason(
            F.lit(verdict), F.lit("issue_refund"), F.lit("0-2k"), F.lit(0.1), F.lit(exposure), F.lit(20.0)))

    assert reason("act", 30.0) == "action exposure is below the cost of human review"
    assert reason("act", 100.0) == "expected loss 10.00 is within earned budget 20.00 for issue_refund in 0-2k"
    assert reason("escalate", 400.0).endswith("human control is retained")


def test_quoted_is_ascii_json(spark):
    import json

    from trustlake.functions.ledger import _quoted

    texts = ["plain", 'a "b" \\ c', "tab\t nl\n cr\r bs\b ff\f nul\x00 esc\x1b del\x7f", "äß é 中文", "😀 and 𝄞", "", "~[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["q"] for r in df.select("i", _quoted(F.col("t")).alias("q")).collect()}
    assert got == {i: json.dumps(t) for i, t in enumerate(texts)}

"""Reliability, ranks, sampling bias, drift, strict JSON, corpus checks, governance."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trustlake.operators import calibration as cal
from trustlake.functions import ledger
from trustlake.operators import drift, governance, ranking, reports, validation


def wrong():
    return F.col("y") == 1


def table(spark, probs, labels, regions=None):
    regions = regions or ["act"] * len(probs)
    rows = [(i, float(p), int(y), r) for i, (p, y, r) in enumerate(zip(probs, labels, regions))]
    return spark.createDataFrame(rows, "id int, p double, y int, region string")


def report(df):
    bins = cal.reliability_bins(df, [], "p", wrong(), "id")
    return bins.orderBy("bin").collect(), cal.reliability(bins, []).first()


def brute(probs, labels, k=10):
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    k = max(1, min(k, len(order)))
    size, extra = divmod(len(order), k)
    start, ece, mce = 0, 0.0, 0.0
    for b in range(k):
        idx = order[start:start + size + (b < extra)]
        start += len(idx)
        gap = abs(sum(labels[i] for i in idx) / len(idx) - sum(probs[i] for i in idx) / len(idx))
        ece += len(idx) / len(order) * gap
        mce = max(mce, gap)
    return ece, mce, sum((p - y) ** 2 for p, y in zip(probs, labels)) / len(probs)


def test_overconfident_model_is_found(spark):
    _, row = report(table(spark, [0.05] * 100, [1, 0, 1, 0, 0] * 20))
    assert row["ece"] == pytest.approx(0.35, abs=1e-9) and row["n"] == 100


def test_bins_have_equal_sizes(spark):
    bins, _ = report(table(spark, [i / 100 for i in range(100)], [0] * 100))
    assert [b["n"] for b in bins] == [10] * 10
    few, _ = report(table(spark, [0.1, 0.2, 0.3], [0, 1, 0]))
    assert [b["n"] for b in few] == [1, 1, 1]


def test_reliability_brute_force_with_heavy_ties(spark):
    rng = random.Random(3)
    probs = [0.04 if rng.random() < 0.4 else round(rng.random() ** 2, 3) for _ in range(997)]
    labels = [int(rng.random() < p) for p in probs]
    _, row = report(table(spark, probs, labels))
    ece, mce, brier = brute(probs, labels)
    assert (row["ece"], row["mce"], row["brier"]) == pytest.approx((ece, mce, brier), abs=1e-12)


def test_good_average_hides_a_bad_close_call_region(spark):
    probs = [0.01] * 1380 + [0.12] * 95
    labels = [1] * 14 + [0] * 1366 + [1] * 32 + [0] * 63
    regions = ["act"] * 1380 + ["close_call"] * 95
    rows = {r["scope"]: r for r in cal.reliability_by_region(table(spark, probs, labels, regions), "p", wrong(), "region", "id").collect()}
    assert rows["global"]["ece"] < 0.05 < 0.08 < rows["close_call"]["ece"]
    assert rows["escalate"]["n"] == 0 and rows["escalate"]["ece"] == 0.0
    assert not rows["close_call"]["has_power"] and rows["act"]["has_power"]
    criteria = cal.calibration_criteria(
        cal.reliability_by_region(table(spark, probs, labels, regions), "p", wrong(), "region", "id")).first()
    assert criteria["passed"] is False


def test_spearman(spark):
    df = spark.createDataFrame(
        [("up", float(i), float(i * i)) for i in range(20)] + [("flat", float(i), 1.0) for i in range(20)]
        + [("one", 1.0, 2.0)] + [("down", float(i % 5), float(-(i % 5))) for i in range(30)],
        "k string, x double, y double",
    )
    got = {r["k"]: r["rho"] for r in cal.spearman(df, ["k"], "x", "y").collect()}
    assert got == pytest.approx({"up": 1.0, "flat": 0.0, "one": 0.0, "down": -1.0})


def test_ipw_and_bias(spark):
    rows = [(1, True)] * 1 + [(0, True)] * 49 + [(1, False)] * 79 + [(0, False)] * 71
    df = spark.createDataFrame(rows, "y int, forced boolean")
    got = cal.sampling_bias(df, [], wrong(), F.col("forced"), 0.0033).first()
    assert (got["naive_rate"], got["ipw_rate"], got["bias"], got["n_forced"]) == pytest.approx((0.40, 0.02, 0.38, 50))
    assert cal.ipw_rate(df.filter("false"), [], wrong(), 0.5).first()["ipw_rate"] == 0.0
    with pytest.raises(ValueError):
        cal.ipw_rate(df, [], wrong(), 0.0)


def test_split_and_halves(spark):
    df = spark.range(11).withColumn("ts", (10 - F.col("id")).cast("bigint"))
    split = {r["id"]: r["split"] for r in cal.temporal_split(df, "ts", "id").collect()}
    assert [split[i] for i in range(11)] == ["test"] * 3 + ["train"] * 8
    halves = {r["id"]: r["half"] for r in cal.halves(df, ["ts", "id"]).collect()}
    assert [halves[i] for i in range(11)] == [1] * 6 + [0] * 5


def test_order_statistics(spark):
    rng = random.Random(1)
    values = sorted(rng.choice([5.0, rng.randrange(50) * 1.0]) for _ in range(333))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranking.order_statistics(
        df, [], "v", {"m": ranking.upper_median(), "p50": ranking.nearest_rank(0.5), "p99": ranking.nearest_rank(0.99)}).first()
    assert got["m"] == values[333 // 2]
    assert got["p50"] == values[int(round(0.5 * 332))] and got["p99"] == values[int(round(0.99 * 332))]


def brute_psi(ref, cur, bins=10):
    o, n = sorted(ref), len(ref)
    edges = [o[min(n - 1, int(round(i * n / bins)))] for i in range(1, bins)]

    def shares(vs):
        counts = [0] * bins
        for v in vs:
            counts[sum(e < v for e in edges)] += 1
        return [max(c / len(vs), 1e-6) for c in counts]

    return sum((c - r) * math.log(c / r) for r, c in zip(shares(ref), shares(cur)))


def test_psi_brute_force(spark):
    rng = random.Random(9)
    ref = [round(rng.gauss(0, 1), 1) for _ in range(705)]
    cur = [round(rng.gauss(0.7, 1), 1) for _ in range(555)]
    rows = [(0, v, None) for v in ref] + [(1, v, 2.0) for v in cur]
    df = spark.createDataFrame(rows, "side int, a double, b double")
    got = {r["feature"]: r for r in drift.psi(df, "side", ["a", "b"]).collect()}
    assert got["a"]["psi"] == pytest.approx(brute_psi(ref, cur), abs=1e-9)
    assert (got["a"]["n_ref"], got["a"]["n_cur"]) == (705, 555)
    assert got["b"]["psi"] == 0.0 and got["b"]["n_cur"] == 555


def test_drift_verdicts(spark):
    rows = [(99, 9.0, 9.0, 9.0), (100, 0.1, 0.4, 0.1), (100, 0.1, 0.1, 0.3), (100, 0.25, 0.05, 0.1), (100, 0.25, 0.2, 0.1), (100, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "n int, s double, l double, d double")
    got = [r["v"] for r in df.select(drift.drift_verdict(*[F.col(c) for c in "nsld"]).alias("v")).collect()]
    assert got == ["insufficient_data", "L3", "L2", "re_anchor", "L1", "ok"]


GOOD = {"p_wrong": 0.5, "verdict": "wrong", "reasons": ["a"]}


@pytest.mark.parametrize(
    "change,ok",
    [({}, True), ({"p_wrong": 1}, True), ({"p_wrong": 0}, True), ({"reasons": []}, True), ({"p_wrong": 1e-7}, True),
     ({"p_wrong": "0.5"}, False), ({"p_wrong": True}, False), ({"p_wrong": 1.01}, False), ({"p_wrong": -0.1}, False),
     ({"p_wrong": None}, False), ({"verdict": "maybe"}, False), ({"verdict": 3}, False), ({"reasons": "a"}, False),
     ({"reasons": ["a", 3]}, False), ({"reasons": ["a", None]}, False), ({"extra": 1}, False)],
)
def test_judge_answers_are_strict(spark, change, ok):
    raw = json.dumps({**GOOD, **change})
    row = cal.validate_judgements(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row["judge_p"] is not None) is ok
    assert row["degraded_reason"] == (None if ok else "TIER2_SCHEMA_VIOLATION")


@pytest.mark.parametrize("raw", ["prose", "", None, "[1]", "{}", '{"p_wrong": 0.1}', '{"p_wrong": NaN, "verdict": "wrong", "reasons": []}'])
def test_judge_prose_is_unavailable(spark, raw):
    row = cal.validate_judgements(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["judge_p"] is None and row["degraded_reason"] == "TIER2_SCHEMA_VIOLATION"


def agent(**change):
    base = {
        "reply_text": "done",
        "claims": {"order_id": "1", "duplicate_charge": True, "refund_amount_paise": 5, "already_refunded": False},
        "action": {"type": "issue_refund", "amount_paise": 5, "order_id": "1"},
    }
    for path, value in change.items():
        part, _, field = path.partition("__")
        if field:
            base[part][field] = value
        else:
            base[part] = value
    return json.dumps(base)


@pytest.mark.parametrize(
    "raw,ok",
    [(agent(), True), (agent(claims__refund_amount_paise="7"), True), (agent(extra=1), True), (agent(reply_text=""), False),
     (agent(claims__refund_amount_paise=-1), False), (agent(claims__refund_amount_paise=5.5), False),
     (agent(claims__order_id=1), False), (agent(claims__duplicate_charge="dunno"), False),
     (agent(action__type="wire"), False), (agent(action__amount_paise=-1), False), (agent(claims=None), False), ("no", False)],
)
def test_agent_answers(spark, raw, ok):
    assert cal.validate_agent_output(spark.createDataFrame([(raw,)], "raw string")).first()["valid"] is ok


# --- corpus checks that must fail -------------------------------------------------


def status(df):
    return df.first()["status"]


def test_label_balance(spark):
    def check(w, c):
        rows = [("wrong",)] * w + [("clean",)] * c + [(None,)]
        return status(validation.label_balance(spark.createDataFrame(rows, "outcome string")))

    assert [check(2, 98), check(3, 97), check(25, 75), check(26, 74), check(0, 0)] == ["FAIL", "PASS", "PASS", "FAIL", "SKIP"]


def test_band_coverage(spark):
    full = [(a,) for a in (100.0, 3000.0, 20000.0, 60000.0) for _ in range(150)]
    df = spark.createDataFrame(full + [(999999.0,)], "amount double")
    assert status(validation.band_coverage(df, "amount", 200000.0)) == "PASS"
    assert status(validation.band_coverage(df.filter("amount <> 100.0"), "amount", 200000.0)) == "FAIL"
    assert status(validation.band_coverage(df.filter("false"), "amount", 200000.0)) == "SKIP"


def test_region_coverage(spark):
    df = spark.createDataFrame([("close_call",)] * 99 + [("act",)] * 9, "region string")
    assert status(validation.region_coverage(df)) == "FAIL"
    assert status(validation.region_coverage(df.unionByName(df.limit(1).withColumn("region", F.lit("close_call"))))) == "PASS"


def test_judge_checks(spark):
    good = spark.createDataFrame([(100, 0.4)], "n bigint, rho double")
    deciles = spark.createDataFrame([(4,)], "deciles bigint")
    assert status(validation.judge_calibration(good, deciles)) == "PASS"
    assert status(validation.judge_calibration(good.withColumn("rho", F.lit(0.2)), deciles)) == "FAIL"
    assert status(validation.judge_calibration(good, deciles.withColumn("deciles", F.lit(2)))) == "FAIL"
    assert status(validation.judge_calibration(good.withColumn("n", F.lit(49)), deciles)) == "SKIP"
    answers = spark.range(100).withColumn("bad", F.col("id").isin(3, 60, 70))
    assert status(validation.judge_schema(answers, "id", F.col("bad"))) == "PASS"
    assert status(validation.judge_schema(answers.withColumn("bad", F.col("id").isin(3, 4)), "id", F.col("bad"))) == "FAIL"
    modes = spark.createDataFrame([("m", "on"), ("m", "off")], "model string, thinking string")
    assert status(validation.judge_mode(modes)) == "FAIL" and status(validation.judge_mode(modes.limit(1))) == "PASS"


def test_gate_blocks_on_one_failure(spark):
    rows = spark.createDataFrame([("a", "PASS", ""), ("b", "SKIP", "")], "check string, status string, detail string")
    assert validation.blocks_fitting(rows).first()["blocked"] is False
    more = validation.validation_gate([rows, rows.withColumn("status", F.lit("FAIL"))])
    assert validation.blocks_fitting(more).first()["blocked"] is True


# --- governance -------------------------------------------------------------------

REGISTRY = (
    "version string, ready_us bigint, state string, capability_tier string, runtime_version string, "
    "ece_global double, ece_close_call double, n_global bigint, n_close_call bigint"
)


def test_promotion_paths(spark):
    rows = [
        ("p", 10, "production", "none", "1", 0.05, 0.08, 900, 900),
        ("old", 5, "production", "none", "1", 0.01, 0.01, 900, 900),
        ("better", None, "candidate", "none", "1", 0.04, 0.07, 100, 100),
        ("thin", None, "candidate", "none", "1", 0.04, 0.07, 100, 99),
        ("half", None, "candidate", "none", "1", 0.04, 0.09, 500, 500),
        ("other", None, "candidate", "none", "2", 0.04, 0.07, 500, 500),
    ]
    got = governance.promotion_path(spark.createDataFrame(rows, REGISTRY), "1").collect()
    assert {r["version"]: r["path"] for r in got} == {"better": "A", "thin": "B", "half": "B", "other": "blocked"}
    assert {r["production"] for r in got} == {"p"}


def test_newest_ready_needs_ready_and_production(spark):
    rows = [("a", 1, "production"), ("b", None, "production"), ("c", 9, "candidate"), ("d", 3, "production")]
    df = spark.createDataFrame(rows, "version string, ready_us bigint, state string").withColumn("capability_tier", F.lit("none"))
    assert governance.newest_ready(df).first()["version"] == "d"


def test_as_of_both_ways(spark):
    rng = random.Random(2)
    versions = [(f"v{i}", rng.randrange(100), rng.choice(["production", "retired", "candidate"]), "none") for i in range(12)]
    registry = spark.createDataFrame(versions, "version string, ready_us bigint, state string, capability_tier string")
    rows = [(i, rng.randrange(-5, 105)) for i in range(400)]
    decisions = spark.createDataFrame(rows, "id int, ts_us bigint").withColumn("capability_tier", F.lit("none"))

    def want(ts):
        live = [(r, v) for v, r, s, _ in versions if s != "candidate" and r <= ts]
        return max(live)[1] if live else None

    for slices in (None, 7):
        got = {r["id"]: r["as_of_version"] for r in governance.calibrator_as_of(decisions, registry, slices=slices).collect()}
        assert got == {i: want(ts) for i, ts in rows}


def test_migration(spark):
    df = spark.createDataFrame([(d,) for d in (0.019, 0.021, 0.050, 0.051)], "d double")
    rows = df.select("d", F.lit(10.0).alias("n_total"), F.lit(8.0).alias("n_clean"), F.lit(10).alias("n_own_raw"),
                     F.lit(0.9).alias("p_lo"), F.lit(5.0).alias("budget"), F.lit("autonomous").alias("state"))
    got = [tuple(r)[1:] for r in governance.migrate_trust(rows, F.col("d")).orderBy("d").collect()]
    assert got == [
        (10.0, 8.0, 10, 0.9, 5.0, "autonomous", "carry"), (5.0, 4.0, 10, 0.9, 5.0, "autonomous", "halve"),
        (5.0, 4.0, 10, 0.9, 5.0, "autonomous", "halve"), (0.0, 0.0, 0, 0.0, 0.0, "supervised", "reset")]


def test_first_budget(spark):
    lengths = spark.range(1, 100).select(F.col("id").alias("n"), ledger.wilson_lower(F.col("id"), F.col("id")).alias("p"))
    earned = lengths.filter(ledger.budget(F.col("p"), F.lit(720.0), F.col("n")) > 0)
    assert earned.agg(F.min("n")).first()[0] == 30


def test_a_key_without_reference_keeps_its_days(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, "old").otherwise("new").alias("agent_id"), F.col("id").alias("ts_us"), (F.col("id") % 10 / 10).alias("p")
    ).filter("agent_id = 'old' or ts_us >= 200")
    got = {(r["agent_id"], r["day"]): r for r in drift.windowed_drift(rows, "p", ["agent_id"], 200, 100).collect()}
    assert set(got) == {("old", 2), ("old", 3), ("new", 2), ("new", 3)}
    new = got["new", 2]
    assert (new["n_ref"], new["n_cur"], new["psi"], new["verdict"]) == (0, 50, None, "insufficient_data")
def test_fail_closed_on_a_random_population(spark):
    rng = random.Random(99)
    rows = []
    for i in range(400):
        amount = rng.uniform(10, 199_999)
        n = rng.choice([0, 20, 73, 200, 400, 5000])
        rows.append((i, amount, rng.betavariate(2, 40), n))
    df = spark.createDataFrame(rows, "id int, amount double, p_wrong double, n int")
    from trustlake.functions import ledger

    df = df.withColumns({
        "pii_score": F.lit(0.05), "injection_score": F.lit(0.02), "secret_score": F.lit(0.0),
        "hard_limit": F.lit(200000.0), "exposure": F.col("amount") * 0.36,
        "budget": ledger.budget(ledger.wilson_lower(F.col("n"), F.col("n")), F.lit(720.0), F.col("n")),
    })
    got = {r["kill"]: r for r in governance.fail_closed_check(df).collect()}
    assert len(got) == 9 and all(r["holds"] and r["n"] == 400 for r in got.values())
    assert got["NONE"]["acts"] > 80 and got["TIER1_UNAVAILABLE"]["acts"] == 0


def test_criteria_status(spark):
    reports_df = spark.createDataFrame([(2, False, "x")], "criterion int, passed boolean, evidence string")
    got = {r["criterion"]: (r["passed"], r["evidence"]) for r in reports.criteria_status(reports_df).collect()}
    assert got[2] == (False, "x") and got[1] == (None, "not run yet") and got[6] == (True, None)


def test_policy_head_never_scores_its_own_rows(spark):
    from trustlake.operators import models

    # the embedding gives the label away from row 60 on only
    rows = spark.range(100).select(
        "id", F.col("id").alias("ts_us"), F.when(F.col("id") % 2 == 0, "wrong").otherwise("clean").alias("outcome"),
        F.when(F.col("id") != 99, F.array(F.when((F.col("id") >= 60) & (F.col("id") % 2 == 0), 4.0).otherwise(0.0))).alias("e"),
    )
    got = {r["id"]: (r["policy_score"], r["policy_score_unavailable"]) for r in models.crossfit_policy_head(rows, "e", "ts_us", "id").collect()}
    assert len(got) == 100 and all(got[i] == (None, 1) for i in [*range(20), 99])
    assert all(abs(got[i][0] - 0.5) < 0.01 for i in range(20, 80))  # the past knows nothing, also of rows 60 to 79
    assert all((got[i][0] > 0.7) == (i % 2 == 0) for i in range(80, 99))


def test_drift_monitor_moves_its_anchor(spark):
    """A state machine by hand: the anchor follows a re-anchoring, and each verdict appears."""
    import math

    shares = {"flat": [10] * 10, "left": [37] + [7] * 9, "steep": [55] + [5] * 9, "right": [7] * 9 + [37]}
    plan = {
        "a": ["flat", "flat", "left", "steep", "flat", "right", "flat"],
        "b": ["left", "flat", "flat"],
        "c": ["flat"],
    }
    rows = [(k, day, *[n * (2 if day else 1) for n in shares[s]]) for k, days in plan.items() for day, s in enumerate(days)]
    rows.append(("a", 7, *[1] * 10))
    names = [f"_c{b}" for b in range(10)]
    days = spark.createDataFrame(rows, "k string, day bigint, " + ", ".join(f"{n} bigint" for n in names))
    reference = spark.createDataFrame([("a", *[100] * 10), ("b", *[100] * 10)], "k string, " + ", ".join(f"_r{b} bigint" for b in range(10)))

    def psi(r, c):
        if not r or not sum(r):
            return None
        total = lambda x: [max(v / sum(x), 1e-6) for v in x]
        return sum((c - r) * math.log(c / r) for r, c in zip(total(r), total(c)))

    want = {}
    for k in plan:
        known = k != "c"
        anchor, at, past = [100] * 10 if known else None, None, []
        for day, cur in sorted((r[1], list(r[2:])) for r in rows if r[0] == k):
            short = [sum(x) for x in zip(*past[-2:])]
            values = psi(short, cur), psi([100] * 10 if known else None, cur), psi(anchor, cur)
            verdict = spark_verdict(sum(cur), *values) if known else "insufficient_data"
            want[k, day] = (verdict, at, *[None if v is None else round(v, 9) for v in values])
            if verdict == "re_anchor":
                anchor, at = cur, day
            past.append(cur)
    got = {
        (r.k, r.day): (r.verdict, r.anchored, *[None if v is None else round(v, 9) for v in (r.psi_short, r.psi_long, r.psi_drift)])
        for r in drift.monitor(days, reference, ["k"], "day", short=2).collect()
    }
    assert got == want
    assert {"ok", "re_anchor", "L1", "L2", "L3", "insufficient_data"} >= {v[0] for v in got.values()} >= {"re_anchor", "L3", "ok", "insufficient_data"}
    assert any(at is not None for _, at, *_ in got.values())


def spark_verdict(n, short, long, anchor):
    if n < 100:
        return "insufficient_data"
    if long is not None and long > 0.30:
        return "L3"
    if anchor is not None and anchor > 0.25:
        return "L2"
    if short is not None and short > 0.20:
        return "re_anchor" if long is not None and long <= 0.10 else "L1"
    return "ok"

"""The second calibrator, the model store, and the whole output of the bootstrap."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trustlake import jobs
from trustlake.config import FEATURE_NAMES
from trustlake.operators import features, gate, models, sampling
from trustlake.sources import model_store


def sample(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0.02 + 0.9 * rng.random() ** 2
        wrong = rng.random() < p
        judge = None if i % 5 == 0 else min(0.99, max(0.01, (0.7 if wrong else 0.2) + rng.uniform(-0.2, 0.2)))
        rows.append((i, 10 * i, p, judge, "wrong" if wrong else "clean"))
    return rows, spark.createDataFrame(rows, "id bigint, ts_us bigint, p double, judge_p double, outcome string")


def test_second_calibrator_uses_both(spark):
    rows, df = sample(spark)
    fitted = models.fit_second(df, "p", "judge_p", F.col("outcome") == "wrong")
    assert fitted.n == sum(r[3] is not None for r in rows) and fitted.model.coefficients[1] > 0.5
    scored = df.withColumn("b", models.second_column(fitted, F.col("p"), F.col("judge_p"))).collect()
    assert all((r["b"] is None) == (r["judge_p"] is None) for r in scored)

    def loss(value):
        return -sum(math.log(value(r) if r["outcome"] == "wrong" else 1 - value(r)) for r in scored if r["b"] is not None)

    assert loss(lambda r: r["b"]) < min(loss(lambda r: r["p"]), loss(lambda r: r["judge_p"]))


def test_second_scores_are_out_of_fold(spark):
    _, df = sample(spark)
    flipped = df.withColumn("outcome", F.when((F.col("id") >= 320) & (F.col("outcome") == "wrong"), "clean").otherwise(F.col("outcome")))
    out, again = (
        {r["id"]: r["p_second"] for r in models.crossfit_second(x, "p", "judge_p", "ts_us", "id").collect()} for x in (df, flipped)
    )
    assert out == again and all(out[i] is None for i in range(80)) and out[81] is not None and out[85] is None


def test_score_column_is_the_model(spark):
    _, df = sample(spark)
    vector = df.withColumn("v", F.array("p", F.col("p") * F.col("p")))
    fitted = models.fit_calibrator(vector, "v", F.col("outcome") == "wrong")
    both = fitted.transform(vector, "v").withColumn("c", models.score_column(fitted, [F.col("v")[0], F.col("v")[1]]))
    assert both.filter(F.abs(F.col("c") - F.col("p_wrong")) > 1e-12).count() == 0
    assert vector.select(models.score_column(models.Calibrator(None, 0.25, 3), [])).first()[0] == 0.25


def test_published_models(spark, tmp_path):
    root = str(tmp_path / "models")
    _, df = sample(spark)
    vector = df.withColumn("v", F.array("p", F.col("p") * F.col("p")))
    fitted = models.fit_calibrator(vector, "v", F.col("outcome") == "wrong")
    model_store.publish(spark, root, "v1", fitted, ["p", "p2"], "rt-2")
    again = model_store.load(spark, root, "v1", ["p", "p2"], "rt-2")
    assert list(again.model.coefficients) == list(fitted.model.coefficients) and again.n == fitted.n
    model_store.publish(spark, root, "rate", models.Calibrator(None, 0.3, 7), ["p", "p2"], "rt-2")
    assert model_store.load(spark, root, "rate", ["p", "p2"], "rt-2").base_rate == 0.3
    with pytest.raises(FileExistsError):
        model_store.publish(spark, root, "v1", fitted, ["p", "p2"], "rt-2")
    for version, inputs, runtime, why in (
        ("v2", ["p", "p2"], "rt-2", "not published"), ("v1", ["p2", "p"], "rt-2", "other inputs"), ("v1", ["p", "p2"], "rt-1", "runtime")
    ):
        with pytest.raises(model_store.RefusedModel, match=why):
            model_store.load(spark, root, version, inputs, runtime)
    # without its mark a version is not there; with another manifest it is refused
    manifest = tmp_path / "models/version=v1/manifest.json"
    manifest.write_text(manifest.read_text().replace("rt-2", "rt-9"))
    (tmp_path / "models/version=v1/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(model_store.RefusedModel, match="mark"):
        model_store.load(spark, root, "v1", ["p", "p2"], "rt-2")
    (tmp_path / "models/version=rate/_PUBLISHED").unlink()
    with pytest.raises(model_store.RefusedModel, match="not published"):
        model_store.load(spark, root, "rate", ["p", "p2"], "rt-2")
    model_store.publish(spark, root, "rate", models.Calibrator(None, 0.4, 7), ["p", "p2"], "rt-2")
    assert model_store.load(spark, root, "rate", ["p", "p2"], "rt-2").base_rate == 0.4


def test_second_model_decides(spark):
    """A close call goes to B, which decides otherwise than the judge's own number would; without an answer it escalates."""
    rows = [(i, "issue_refund", "adaptive", 0.055, 2520.0, 128.92, False, "close_calls", "check_harder") for i in (1, 2, 3)]
    close = spark.createDataFrame(
        rows, "id int, action string, policy_mode string, p_wrong double, exposure double, budget double, violated boolean, tier2_mode string, verdict string"
    )
    answers = spark.createDataFrame([(1, 0.9, None), (2, 0.01, None)], "id int, judge_p double, degraded_reason string")
    b = F.when(F.col("judge_p").isNotNull(), F.col("p_wrong") * 0.5 + F.col("judge_p") * 0.02)
    own = {r["id"]: r["verdict"] for r in gate.resolve_tier2(close, answers).collect()}
    got = {r["id"]: (r["verdict"], r["p_wrong"]) for r in gate.resolve_tier2(close, answers, b).collect()}
    assert own == {1: "escalate", 2: "act", 3: "escalate"}
    assert got[1] == ("act", pytest.approx(0.0455)) and got[2] == ("act", pytest.approx(0.0277)) and got[3] == ("escalate", 0.055)


def test_bootstrap_has_all_outputs(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        wrong = i % 13 == 0
        judge = 0.8 if wrong else 0.1
        rows.append((i, i * 10, "issue_refund", 5000.0, "2k-10k", "wrong" if wrong else "clean", 0.6 if wrong else 0.1, 0.0, 0.0, 0.0,
                     judge if i % 3 else None, [rng.random() + wrong, rng.random()]))
    df = spark.createDataFrame(rows, "id bigint, ts_us bigint, action string, amount double, band string, outcome string, verify_fail_frac double, "
                               "pii_score double, injection_score double, secret_score double, judge_p_wrong double, embedding array<double>")
    turns = features.assemble_features(df, F.col("ts_us"), "none", ("logprob_mean", "logprob_min"))
    wide = turns.select("id", "ts_us", "action", "amount", "band", "outcome", "features", "embedding")
    store = str(tmp_path / "models")
    out = jobs.bootstrap(wide, embedding="embedding", version="cal-v7", runtime_version="rt-2", store=store)
    base = out["baseline"].first()
    judged = sum(1 for r in rows[:320] if r[10] is not None)
    assert (base["version"], base["n_train"], base["n_test"], base["n_second"], base["boundary_us"]) == ("cal-v7", 320, 80, judged, 3200)
    assert 0 <= base["ece_global"] <= 1 and base["fallback_prior"] == pytest.approx(sum(r[5] == "wrong" for r in rows[:320]) / 320)
    registry = out["registry"].first()
    assert (registry["version"], registry["state"], registry["ready_us"], registry["rows_carried"]) == ("cal-v7", "production", 3990, 320)
    scored = out["scored"].select("id", F.col("features.policy_score").alias("s"), F.col("features.policy_score_unavailable").alias("u")).collect()
    assert all((r["s"] is None) == (r["id"] < 80) and r["u"] == int(r["id"] < 80) for r in scored)
    second = {r["id"]: r["p_second"] for r in out["second"].collect()}
    assert len(second) == 400 and second[81] is None and second[82] is not None
    names = features.vector_names(features.model_features("none", with_judge=False))
    assert model_store.load(spark, store, "cal-v7-a", names, "rt-2").n == 320
    assert model_store.load(spark, store, "cal-v7-b", models.STACKED, "rt-2").n == judged
    assert set(base["model_a_features"]) < set(FEATURE_NAMES)


@pytest.mark.parametrize("total", [0, 3, 7, 20, 100])
def test_turns_in_closed_form(total):
    sizes = [5, 0, 11, 2, 9]
    queues, taken = list(sizes), [0] * 5
    while sum(taken) < total and any(queues):
        for i in range(5):
            if queues[i] and sum(taken) < total:
                queues[i] -= 1
                taken[i] += 1
    assert sampling.turns_taken(sizes, total) == taken


def test_quota_by_thresholds(spark):
    import hashlib

    rows = [(i, "big" if i % 4 else ("small" if i % 40 == 0 else "other"), i) for i in range(4000)]
    rows += [(5000 + i, None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, band string, x int")
    draw = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    by = {b: sorted((r[0] for r in rows if r[1] == b), key=draw) for b in ("big", "small", "none here")}
    for total in (9, 600, 3000, 9000):
        want = [i for b in by.values() for i in b[: total // 3]]
        rest = sorted({r[0] for r in rows} - set(want), key=draw)
        want = set(want) | set(rest[: total - len(want)])
        got = [r["id"] for r in sampling.quota_sample(df, "band", "id", list(by), total).collect()]
        assert len(got) == len(set(got)) and set(got) == want

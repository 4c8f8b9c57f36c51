"""The nightly run and the bootstrap, end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from trustlake import jobs
from trustlake.operators import features
from trustlake.sources import tables

from .test_trust_and_outcomes import EVENTS, SCHEMA

KEY = ("a", "issue_refund", "10k-50k", "f")
DECISIONS = SCHEMA + ", horizon_us bigint"


@pytest.fixture()
def night(spark):
    rows = [(i, i, *KEY, "clean", "record_verification", i, 50) for i in range(120)]
    rows += [(200, 500, *KEY, None, None, None, 600), (201, 501, *KEY, None, None, None, 9000)]
    decisions = spark.createDataFrame(rows, DECISIONS)
    events = spark.createDataFrame(
        [(1, 200, 550, "wrong", "reversal", 0.9, None), (2, 201, 550, "wrong", "reversal", 0.9, None)], EVENTS
    )
    return decisions, events


def test_nightly_twice(spark, night):
    decisions, events = night
    first = jobs.nightly(decisions, events, 1000)
    assert [r["decision_id"] for r in first["closed"].collect()] == [200]
    row = first["trust"].first()
    assert row["n_own_raw"] == 121 and row["tripped_at"] is None and row["updated_at"] == 1000
    assert first["drift_checks"].first()["verdict"] == "checked"
    again = jobs.nightly(first["decisions"], first["events"], 1000, old_trust=first["trust"])
    assert again["closed"].count() == 0 and again["trust"].first() == row


def test_nightly_keeps_rows_it_did_not_touch(spark, night):
    decisions, events = night
    old = jobs.nightly(decisions, events, 1000)["trust"].withColumn("agent_id", F.lit("gone"))
    merged = jobs.nightly(decisions, events, 1000, old_trust=old)["trust"]
    assert {r["agent_id"] for r in merged.collect()} == {"a", "gone"}


def test_command_line(spark, night, tmp_path, capsys):
    decisions, events = night
    decisions.write.parquet(f"{tmp_path}/d")
    events.write.parquet(f"{tmp_path}/e")
    args = ["--decisions", f"{tmp_path}/d", "--events", f"{tmp_path}/e", "--trust", f"{tmp_path}/t", "--as-of", "0.001"]
    assert jobs.main([*args, "--dry-run"]) == 0 and tables.snapshots(spark, f"{tmp_path}/t") == []
    capsys.readouterr()
    assert jobs.main(args) == 0 and jobs.main(args) == 0
    assert tables.snapshots(spark, f"{tmp_path}/t") == [1, 2]
    said = capsys.readouterr().out.splitlines()
    assert [x[:17] for x in said] == ["closed 1 outcomes", "closed 0 outcomes"] and "1 trust rows, 1 keys" in said[1]
    with pytest.raises(SystemExit):
        jobs.main(args[:-2])


def test_a_closed_outcome_stays(spark, night, tmp_path):
    decisions, events = night
    root = f"{tmp_path}/t"
    jobs.run_nightly(spark, decisions, events, root, 1000)
    heavier = spark.createDataFrame([(3, 200, 900, "clean", "human_override", 1.0, None)], EVENTS)
    out = jobs.run_nightly(spark, decisions, events.unionByName(heavier), root, 10_000)
    assert [r["decision_id"] for r in out["closed"].collect()] == [201]
    closed = {r["decision_id"]: (r["outcome"], r["closed_us"]) for r in tables.read_segments(spark, f"{root}-closed", 2).collect()}
    assert closed == {200: ("wrong", 1000), 201: ("wrong", 10_000)}
    assert {r["event_id"]: r["processed_us"] for r in out["events"].collect()} == {1: 1000, 2: 10_000, 3: 1000}
    assert out["trust"].first()["n_own_raw"] == 122
    assert tables.read_snapshot(spark, f"{root}-drift").first()["run_us"] == 10_000


def test_a_night_writes_what_it_closes(spark, night, tmp_path):
    """Every run appends its own closings; merged segments hold the same rows, and a broken-off run is done again."""
    decisions, events = night
    root = f"{tmp_path}/t"
    rows = [(300 + i, 600, *KEY, None, None, None, 1000 * i) for i in range(1, 10)]
    decisions = decisions.unionByName(spark.createDataFrame(rows, DECISIONS))
    more = spark.createDataFrame([(10 + i, 300 + i, 700, "clean", "reversal", 0.9, None) for i in range(1, 10)], EVENTS)
    events = events.unionByName(more)
    for i in range(1, 10):
        jobs.run_nightly(spark, decisions, events, root, 1000 * i + 1)
        assert spark.read.parquet(f"{root}-closed/from={i}-to={i}").count() <= 2
    log = f"{root}-closed"
    assert [s.rpartition("/")[2] for s in tables.segments(spark, log, 9)] == ["from=1-to=8", "from=9-to=9"]
    closed = sorted(r["decision_id"] for r in tables.read_segments(spark, log, 9).collect())
    assert closed == [200, 201, *range(301, 310)]
    assert tables.vacuum_segments(spark, log, 9) == 8 and tables.vacuum_segments(spark, log, 9) == 0
    assert sorted(r["decision_id"] for r in tables.read_segments(spark, log, 9).collect()) == closed
    # a tenth run that wrote its segment but no trust snapshot
    tables.append_segment(tables.read_segments(spark, log, 9), log, 10)
    out = jobs.run_nightly(spark, decisions, events, root, 10_001)
    assert out["closed"].count() == 0 and spark.read.parquet(f"{log}/from=10-to=10").count() == 0


def test_bootstrap(spark):
    rows = spark.range(400).select(
        "id", (F.col("id") * 10).alias("ts_us"), F.lit("issue_refund").alias("action"), F.lit(5000.0).alias("amount"),
        F.lit("2k-10k").alias("band"),
        F.when(F.col("id") % 17 == 0, "wrong").otherwise("clean").alias("outcome"),
        F.when(F.col("id") % 17 == 0, 0.6).otherwise(0.1).alias("verify_fail_frac"),
        F.lit(0.0).alias("pii_score"), F.lit(0.0).alias("injection_score"), F.lit(0.0).alias("secret_score"),
    )
    turns = features.assemble_features(rows, F.col("ts_us"), "none", ("judge_p_wrong", "logprob_mean", "logprob_min"))
    out = jobs.bootstrap(turns.select("id", "ts_us", "action", "amount", "band", "outcome", "features"))
    scored = out["scored"].orderBy("id").collect()
    assert [r["split"] for r in scored] == ["train"] * 320 + ["test"] * 80
    assert all(r["verdict"] == "escalate" for r in scored[:30]) and {r["verdict"] for r in scored[200:]} > {"act"}
    assert out["held_out"].first()["n"] == 80
    trust = out["trust"].first()
    assert (trust["n_clean"], trust["n_total"], trust["state"]) == (376, 400, "autonomous")
    nulls = {r["feature"]: r["null_rate"] for r in out["null_rates"].collect()}
    assert nulls["logprob_mean"] == 1.0 and nulls["pii_score"] == 0.0


def test_close_call_delta(spark):
    new, old = (spark.createDataFrame([(v,)], "ece_close_call double") for v in (0.07, 0.04))
    assert spark.range(1).select(jobs.close_call_delta(new, old).alias("d")).first()["d"] == pytest.approx(0.03)


def test_written_tables_are_read_by_column(spark):
    """A pass over a few columns of a wide table reads these only, which a checkpoint of rows cannot."""
    from trustlake.session import written

    out = written(spark.range(10).select("id", F.array(F.col("id").cast("double")).alias("vector")))
    plan = out.filter("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and out.count() == 10

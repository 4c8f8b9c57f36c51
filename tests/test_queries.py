"""Every registered query at the smallest scale: its plan, and its rows against its SQL where there is one.

Automatic broadcasts are off, so the joins that large tables would get are the
ones that run, and only those broadcasts remain that the code asks for.
"""

import pytest

from trustlake.plans import catalog

from .oracle_check import compare, duck

NAMES = sorted(catalog.QUERIES)
PYTHON = {"fit_platt", "fit_platt_steps"}
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.fixture(scope="module", autouse=True)
def no_auto_broadcast(spark):
    before = {n: spark.conf.get(n, None) for n in THRESHOLDS}
    for n in THRESHOLDS:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "EvalPython" not in plan and "InPandas" not in plan
    if name in catalog.ORACLES:
        problem = compare(df, con, catalog.ORACLES[name])
        assert problem in ("", "EMPTY"), problem
    else:
        assert df.count() > 0


def test_most_queries_have_a_check():
    unchecked = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert unchecked == {
        "text_model_scores", "fit_calibrator", "fit_platt", "fit_policy_head", "expanding_crossfit",
        "bootstrap_scored", "stream_span_scores",
    }


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["band", "verdict", "n"] and df.count() > 0

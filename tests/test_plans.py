"""Plan shapes: what reaches the scan and what does not shuffle."""

import pytest

from trustlake.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name,columns",
    [
        ("band_counts", {"o_totalprice"}),
        ("wilson_by_agent", {"o_orderkey", "o_custkey"}),
        ("hedge_density", {"doc_id", "text"}),
        ("added_latency", {"o_orderkey"}),
        ("outcome_ingest", {"event_id", "event_type"}),
    ],
)
def test_scans_read_only_what_they_need(spark, sf, name, columns):
    text = plan(catalog.QUERIES[name](spark, sf))
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {part.split(":")[0] for part in read.split(",")} <= columns


def test_filters_reach_the_scan(spark, sf):
    assert "EqualTo(role,user)" in plan(catalog.QUERIES["example_fields"](spark, sf))


def test_text_scans_do_not_shuffle(spark, sf):
    for name in ("secret_scan", "pii_scan", "hedge_density", "span_counts"):
        assert "Exchange" not in plan(catalog.QUERIES[name](spark, sf))


def test_winners_are_grouped_not_ranked(spark, sf):
    text = plan(catalog.QUERIES["resolve_outcomes"](spark, sf))
    assert "Window" not in text and "partial_max" in text


def test_row_windows_are_cut_by_slice(spark, sf):
    for name in ("replay_gate", "length_z", "reliability", "breaker_state"):
        windows = [line for line in plan(catalog.QUERIES[name](spark, sf)).splitlines() if "windowspecdefinition" in line]
        # "_s_" columns are the sums per slice, at most one row per key and slice
        assert windows and all("_slice" in line or "sum(_s_" in line for line in windows)

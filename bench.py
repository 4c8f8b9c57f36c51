"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores.
Every query is run to the end over its whole tables; nothing is cached in between.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trustlake.plans import catalog  # noqa: E402
from trustlake.session import build_session  # noqa: E402

HEADLINE = (
    "replay_gate", "replay_rows", "decide_batch", "tier2_resolution", "exposure_by_action", "fingerprints",
    "verify_claims", "label_outcomes", "order_pools", "ledger_lines",
    "span_counts", "hedge_density", "retrieval_support", "secret_scan", "pii_scan", "last_user_text",
    "length_z", "assemble_features", "resolve_outcomes", "close_decisions", "weighted_counts", "recent_failures",
    "breaker_state", "recompute_trust", "reliability", "reliability_by_region", "spearman_by_agent",
    "psi_features", "windowed_drift", "validation_gate", "calibrator_as_of", "quota_sample",
    "release_summary", "latency_summary", "fail_closed", "fit_calibrator", "fit_platt",
    "stream_decide", "stream_length_z", "stream_outcome_ingest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("trustlake-bench", master=f"local[{cpus}]", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers once, outside the clock
    for name in ("replay_gate", "verify_claims", "psi_features", "secret_scan", "fit_platt"):
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

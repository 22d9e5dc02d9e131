"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores.  Each query runs
twice over the whole tables and the second run is reported, so that JVM start and code
generation are left out; every result is written to the no-op sink in full.
"""

from __future__ import annotations

import json
import os
import time

from check import session
from trialforge.catalog import QUERIES

HEADLINE = [
    "A1_load_trials",
    "C1_completers",
    "D2_phase_metrics",
    "E1_collapse",
    "G3_choice_matrix_training",
    "G5_derived_shares",
    "G9_overview",
    "H3_participant_summary",
    "K6_experiment_table",
    "L1_t_test_one",
    "L2_t_test_welch",
    "L3_bf_one_sample",
    "L4_bf_paired",
    "L5_bf_two_sample",
    "L6_signed_rank",
    "M2_study_frame",
    "M3_dot_bins",
    "N1_rolling_criterion",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times,
             "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

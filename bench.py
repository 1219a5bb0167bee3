"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores of the local session, and
``BENCH_QUERIES`` (comma separated) picks other registered queries. A query is run in
full: its rows are written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "A1_audit_coverage",
    "A7_giveaway_labels",
    "A8_site_giveaway",
    "A10_codes_by_class",
    "P7_flag_columns",
    "A12_tags_by_class",
    "K9_viable_tasks",
    "W3_split_sample_rows",
    "W7_spectral_job",
    "K3_validation_holdout",
    "K4_repeated_folds",
    "M5_lookup_model",
    "G1_roll_up_windows",
    "G3_count_metrics",
    "G5_roc_auc",
    "U5_cluster_bootstrap",
    "U8_benjamini_hochberg",
    "U14_overview",
    "U15_ambiguity",
    "M7_fit_probe",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE
    spark = local_session(cpus, name="tidemark-bench")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

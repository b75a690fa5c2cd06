"""Wall-clock of the headline queries, as one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from ledgerloom.plans.queries import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "order_total_reconciliation", "signed_control_totals", "verdicts_under_thresholds",
    "verdict_roll_up", "population_gaps", "cell_edges", "buried_literals", "skipped_rows",
    "conflicting_names", "all_findings", "label_mappings", "internal_reconciliation",
    "ledger_lines", "disclosure_manifest", "log_append", "log_verification", "audit_events",
    "recovery_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16)
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    took = {}
    for name in sys.argv[1:] or HEADLINE:  # any other query by name
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, wall clock", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

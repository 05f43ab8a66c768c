"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from voxelcohort.plans import catalog
from voxelcohort.session import build_session

HEADLINE = (
    "flagship_cohort_summary", "overlap_metrics", "overlap_metrics_dense", "roc_auc", "label_components_26",
    "evaluate_cases", "head_support", "fill_holes", "close_2d", "median_filter", "nine_features", "prepare_pixels",
    "histogram_match", "intensity_audit", "tensor_audit", "support_sample", "fit_normalization", "apply_normalization",
    "balanced_sample", "kfold", "check_folds", "reconcile_inventory", "paired_summary", "metric_summary",
    "input_signature", "stale_cases", "trace_violations", "classify_paths", "assemble_cases", "geometry_matches",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before timing
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())

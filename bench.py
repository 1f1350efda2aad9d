"""Times headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
The cache is cleared before every query, so each pays for its own scans.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "check1_pseudoreplication",
    "check2_double_dipping",
    "check3_fragility",
    "check4_confounding_separable",
    "check5_multiple_testing",
    "check6_unmodeled_covariate",
    "check7_resolution_by_ari",
    "check8_test_assumptions",
    "answer_key",
    "truth_labels",
    "pseudobulk_region_nation_brand",
    "welch_by_brand",
    "fdr_bh",
    "cramers_v_all_technical",
    "auc_by_brand_per_region",
    "thin_counts",
    "holdout_report",
    "ari_adjacent",
    "silhouette_by_setting",
    "column_profile",
    "claim_demotion",
    "run_expansion",
    "numeric_comparator",
    "confusion_rollup",
    "negative_binomial_wald",
]


def main() -> None:
    from plumbline.plans.catalogue import PLANS
    from plumbline.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    PLANS["student_t_tail"](spark, sf).collect()  # start the Python workers
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        spark.catalog.clearCache()
        started = time.time()
        PLANS[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

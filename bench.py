"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one
JSON line. Each query is executed in full through the ``noop`` sink (no driver collect)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fundlens.plans.registry import QUERIES, load_all  # noqa: E402
from fundlens.session import local_session  # noqa: E402

HEADLINE = [
    "f7_create_features",       # every daily window feature (one Exchange + one Sort)
    "a8_aggregate_features",    # 32 fund-level features
    "k1_dedupe_keep_max",       # skew-safe keep-max dedupe over raw rows
    "c6_clean",                 # cleaning chain incl. exact global tail quantiles
    "x7_build_features",        # clean -> split -> per-split features -> fund features
    "x4_load_panel",            # CSV tree -> canonical panel (files written once, untimed)
    "m5_silhouette",            # exact Euclidean silhouette (block pairs)
    "m8_wasserstein_1d",        # exact distributed W1
    "m12_stability_report",     # evaluation + selection + stability
    "s7_project_quota_cols",    # monthly archives, one read (written once, untimed)
    "x5_ingest_initial",        # archives -> catalog semi join -> latest row per key
    "v6_feature_summary",       # exact quartiles and distinct counts of every daily feature
    "m6_calinski_harabasz",     # centroids and dispersion without exploding the vectors
    "x8_run_and_report",        # grid -> results -> selection -> stability
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = max(8, 2 * int(cpus)) if cpus.isdigit() else 16
    spark = local_session(cores=cpus, shuffle_partitions=parts, app="fundlens-bench")
    load_all()
    from fundlens.plans.queries_io import monthly_zip_tree, raw_csv_tree

    if "x4_load_panel" in HEADLINE:
        raw_csv_tree(spark, sf_dir)  # input files for the load benchmarks (untimed)
        monthly_zip_tree(spark, sf_dir)
    # untimed warm-up on the smallest tables: JIT / codegen compile once per process, as in any
    # long-running cluster application; the timed pass below then measures steady-state work
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        if "x4_load_panel" in HEADLINE:
            raw_csv_tree(spark, warm_dir)
            monthly_zip_tree(spark, warm_dir)
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

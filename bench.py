"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice and the second run counts; ``cold`` has the first runs, with class
loading and first-time code generation. A query is built, planned and run in full each time:
fitted models are forgotten and staged folders deleted between runs, and where a query fits
models, ``fit`` has that part of its counted time.
"""

from __future__ import annotations

import json
import os
import time

from brineframe.plans import model_queries
from brineframe.plans.registry import all_queries
from brineframe.session import local_session, release_shared_dirs

HEADLINE = [
    "column_metrics", "peak_depth_box_monthly_mean", "monthly_mean_map", "zonal_band_profile", "block_mean_4x4",
    "densified_grid", "matchup_24h_window", "random_point_samples", "pct_missing_by_day", "suspect_profiles",
    "depth_percentiles", "depth_metrics_table", "peak_comparison", "smoothed_profiles", "daily_evaluation",
    "distance_to_coast", "normalised_training_table", "sample_without_replacement", "profile_indicators",
    "regrid_bilinear", "published_cube_round_trip", "daily_product",
]
FITTING = {"daily_product"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    registered = all_queries()
    seconds, cold, fit = {}, {}, {}
    for name in HEADLINE:
        for runs in (cold, seconds):
            model_queries.forget_models()
            start = time.perf_counter()
            if name in FITTING:
                model_queries.depth_models(spark, sf_dir)
                fit[name] = round(time.perf_counter() - start, 3)
            registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
            release_shared_dirs(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "fit": fit,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

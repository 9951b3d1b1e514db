"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession

from cytomesh import registry

HEADLINE = [
    "ref_stats", "flag_cells", "image_counts", "grid_density_cv", "nn_features", "contact_ratio", "degree_distribution", "clusters", "image_features", "classify_field",
    "frame_deltas", "motion_profile", "longest_run", "keyframes", "field_controller", "temporal_smoothing", "nav_state", "coverage_grid", "semantic_grid", "coverage_eval",
    "covered_fraction", "staleness", "priority_dequeue", "lowe_matches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registry.QUERIES["ref_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

"""Runs the headline queries and prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cellweave.plans.catalogue import QUERIES

HEADLINE = (
    "roi_summary", "f1_count_aggregation", "f5_qc_metrics", "f6_dataset_comparison", "f9_mad_bounds", "d5_gene_filter", "e1_bin_attribution",
    "e8_weighted_attribution", "e9_nearest_point", "e10_radius_join", "e12_touching_cells", "e15_label_expansion", "f14_neighbour_divergence",
    "f16_group_means", "f19_gene_variance", "f20_neighbourhoods", "f23_grid_ratio", "f26_panoptic_quality", "g1_average_ranks", "g12_majority_label",
    "j4_log_normalise", "k1_mann_whitney", "k4_friedman", "k7_morans_i", "k8_composite_score", "k11_rank_sum_markers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first one warms up
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "sum of medians of headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()

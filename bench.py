"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from kinset.operators import deletion
from kinset.plans import catalogue, statistics_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

CELLS = {
    "estimator_accuracy_j05": lambda s: statistics_queries.diagnose(statistics_queries.estimator_trials(s, 1000, 666, 128, 64, 50)),
    "deletion_exact": lambda s: deletion.deletion_limits(deletion.survival_curve(s, 1000, 5, 128), 0.99),
    "deletion_mc": lambda s: deletion.failure_histogram(deletion.simulate(s, 1000, 5, 128, 1000)),
}
TABLES = (
    "document_accuracy",
    "document_exact_similarity",
    "ag1_minhash_signature",
    "ag5_corrected_jaccard",
    "ag7_bottom_d",
    "ag9_bucket_scaffold",
    "ag11_confusion",
    "ag20_calibrate",
    "jn4_related_pairs",
    "flt2_dedup_messages",
    "st1_bottom_fold",
    "str5_shingles",
    "ag17_estimator_diagnostics",
    "ma7_deletion_limits",
    "gen4_threshold_grid",
    "jn5_unrelated_pairs",
    "jn10_chunked_vectors",
    "flt4_cheapest_feasible",
    "st6_epoch_store",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = dict(CELLS) | {name: (lambda s, q=catalogue.QUERIES[name]: q(s, SF_DIR)) for name in TABLES}
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, run in runs.items():
        began = time.perf_counter()
        run(spark).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()

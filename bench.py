"""Time the headline queries; prints one JSON line.

Every query is timed on a study of its own, prepared from the input tables, so nothing computed
for one query shortens another. ``g4_workflow_summary`` is the whole chain.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sensorhealth import catalog
from sensorhealth.plans import prepared as prep
from sensorhealth.session import local_scratch, ship

HEADLINES = (
    "f1_rolling_mean",
    "f2_rolling_median",
    "f8_back_fill",
    "t4_cycle_plan",
    "t11_evaluation_anchors",
    "f11_scaler_apply",
    "c2_cdf_apply",
    "c5_segmented_risk",
    "c6_threshold_sweep",
    "e13_lead_time_scores",
    "g4_workflow_summary",
    "m2_forest_score",
    "m4_forest_refit_scores",
    "m10_linear_per_maintenance",
    "h1_candidate_objectives",
    "h7_pareto_front",
    "g11_contract_report",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(local_scratch(spark))
    catalog.load()
    spark.read.parquet(f"{directory}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINES:
        prep.forget(spark)
        start = time.perf_counter()
        catalog.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(directory)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

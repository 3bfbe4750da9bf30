"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Every query is run
to completion over its whole input; the time includes planning and staging.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import load  # noqa: E402

HEADLINE = (
    "f1_breadth_features", "f3_moneyflow_features", "a2_return_distribution", "a13_trend_breadth", "j4_asof_strict", "j7_densify", "w8_prior_normalise",
    "w15_weighted_median_scale", "c2_platt_calibration", "d6_evidence_guard", "m8_non_regression_gate", "r7_weighted_vote", "l2_downside_logistic",
    "g4_insert_plan", "g16_tumbling_bars", "e3_rule_family",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

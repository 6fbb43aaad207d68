"""Times the headline queries on one machine, the best of up to three runs each: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans.queries import QUERIES

#: Positions and what is built on them, frontiers, quotes, pages: one of each kind of plan.
HEADLINE = (
    "agg1_positions", "j4_dense_grid", "j6_contradictions", "agg5_axis_correlation", "job8_explained", "job10_points", "win1_frontier",
    "agg17_cadence", "job1_validated_claims", "str8_passages",
    "dat4_page_dates", "job9_verified_events", "win6_turns", "agg9_clustered",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(
            "spark.sql.shuffle.partitions", cpus
        ).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and sum(runs) < 40:  # the best of three; of the longest ones, of fewer
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

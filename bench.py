"""Times the headline queries, warm, each result consumed in full; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from trailmesh.plans.queries import QUERIES

NAMES = ["clean_points", "tracked_points", "track_kinematics", "od_matrix", "home_places", "mode_rules_no_rail", "mode_rules", "speed_band_shares", "match_candidates", "match_path"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            t = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total warm seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(d.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()

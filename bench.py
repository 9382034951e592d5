"""Times the headline queries: one warm-up, then the median of three; prints one JSON line. `ratios` are the times over that of
a query whose code stays, so that rounds on machines of other speeds can be compared."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from hostloom.plans import registry

HEADLINE = (
    "det1_outliers", "det2_high_risk", "det3_version_sprawl", "det4_detections", "det5_decide_findings", "agg3_software_inventory", "agg6_users_by_software", "agg9_extension_inventory",
    "gr1_blast_software", "gr6_full_graph", "ing3_software_rows", "mrg4_upsert_software", "mrg6_upsert_installs", "set2_diff_nodes", "set3_diff_properties", "set4_diff_edges", "s13_score_extensions", "cat6_categorize", "run2_latest", "flt5_search",
)

YARDSTICK = "flt5_search"


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] or HEADLINE if n in registry.QUERIES]
    took = {}
    for name in names:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    ratios = {n: round(t / took[YARDSTICK], 2) for n, t in took.items()} if YARDSTICK in took else {}
    print(json.dumps({"metric": "sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ratios": ratios, "sf": os.path.basename(os.path.normpath(sf_dir))}))


if __name__ == "__main__":
    main()

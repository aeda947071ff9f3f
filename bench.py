"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans.registry import QUERIES

NAMES = ["entry", "range_scan", "win_avg", "win_stddev", "downsample_500", "execute_many", "block_stats", "store_stats", "codec_roundtrip", "percentiles", "pearson", "rolling_corr", "rollup_hour_day", "latest_point"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
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
    for name in NAMES:
        times = []
        for _ in range(3):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times), 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(out | {"points_per_sec": {k: round(n / v) for k, v in took.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()

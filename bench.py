"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is materialised in full (every column of every row) with the no-op sink. Sessions and Python workers are warmed up on the smallest tables first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship", "native_scan", "redact_mask", "policy_decision", "norm_full", "detect_full", "filter_full", "span_fuse_vote", "arbitrated", "pipeline_merge", "max_merge",
    "alias_map", "unfilter_roundtrip", "eval_metrics", "eval_confusion", "corpus_report", "proxied_conversations", "stratified_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")  # small files: enough splits for all cores
        .config("spark.sql.files.openCostInBytes", "128k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from piispan.queries import queries

    own = queries()
    warm = str(Path(sf_dir).parent / "sf0.001")
    for name in ("flagship", "detect_full", "arbitrated"):
        own[name](spark, warm).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        own[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

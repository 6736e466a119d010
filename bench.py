"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS say on what."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from docframe.plans import QUERIES

HEADLINE = (
    "flagship", "where_eq", "where_regex", "range_scan", "order_limit_skip", "sql_group_having", "group_by_builder", "columnar_aggregate", "field_stats", "latency_percentiles", "join_flat_inner", "join_nested_left", "join_chain",
    "reactive_link", "text_search", "bm25_topk", "vector_topk", "vector_batch_topk", "hybrid_rrf", "scored_query", "ts_downsample_avg", "as_of_snapshot", "cdc_counts", "shard_counts", "schema_validate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

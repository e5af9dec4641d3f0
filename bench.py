"""Seconds of the headline queries, each written out in full: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and the cores.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "b1_materialize", "c1_transform", "c15_accumulate", "d1_make_tuple_3", "d3_bulk_upsert", "d8_lower_bound", "d9_point_probe", "e2_checksum", "f1_unique",
    "g1_sort", "g4_stable_sort", "g19_top_k", "g29_top_per_key", "h2_naming", "j7_stack", "k12_log_with_deletes", "l4_multiply", "l5_multiply_blocked", "n1_call_bills", "n8_random_graph",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

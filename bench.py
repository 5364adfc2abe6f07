"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stocklens.plans.registry import all_queries  # noqa: E402
from stocklens.session import build_session  # noqa: E402

HEADLINE = [
    "q01_q11_completeness", "c01_c09_content", "d03_duplicate_name", "v01_v05_variants", "g01_g07_category_feed",
    "j06_near_duplicate_documents", "a01_catalog_stats", "w01_stock_order", "l01_link_products", "r02_j10_mapping",
    "x01_page_features", "x04_x12_page_issues", "j11_x16_link_checks", "e03_e06_p29_parameters", "w05_j14_status_changes",
]


def in_many_parts(spark, sf_dir: str, parts: int) -> str:
    """The same tables, written once in several files. The given ones have one row group each, which would leave all
    work on a text to one core; tables of the size that the queries are made for have many."""
    folder = tempfile.mkdtemp(prefix="stocklens-bench-")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(parts).write.parquet(f"{folder}/{path.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "stocklens-bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    queries, seconds = all_queries(), {}
    tables = in_many_parts(spark, sf_dir, 2 * int(cpus))  # neither this nor the start-up is part of any query
    for name in names:
        start = time.perf_counter()
        queries[name](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries on ``$BENCH_SF_DIR``, local[$BENCH_CPUS]: prints one JSON line.

Every result is computed in full and thrown away; a query's time is the median of
``$BENCH_RUNS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conformance import QUERIES  # noqa: E402
from loomrow.session import get_session  # noqa: E402

HEADLINE = [
    "map_conversations", "map_json_lines", "map_prompt_response", "map_dynamic_array", "map_nested_full", "map_cast",
    "map_and_validate", "validate_rows", "validation_report", "infer_schema_typed", "infer_schema_json",
    "extract_tags", "extract_tags_html", "truncate_text", "normalize_sample", "scan_jsonl", "quarantine_bad_rows",
    "map_dataset_stats", "save_results", "catalog_latest", "catalog_obsolete", "catalog_upsert",
    "catalog_upsert_null", "sql_inner_join", "sql_rank", "sql_count_distinct",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="loomrow-"),
    })
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()

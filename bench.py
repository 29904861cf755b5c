"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, the median of three warm runs of each."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

QUERIES = [
    "head_tags_wide", "if_condition", "derived_columns", "dict_join", "upsert_last_wins", "priority_dedup", "pivot_columns", "locf", "running_with_reset",
    "partition_prefix_sum", "geo_interpolate", "nearest_non_null", "file_order_mixed", "overlay_import", "jpeg_segments", "swf_frames", "text_escape", "svg_path",
]


def main() -> None:
    from siftlens import plans
    from siftlens.session import session

    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        runs = []
        for _ in range(3):
            began = time.time()
            plans.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()

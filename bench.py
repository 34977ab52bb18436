"""Seconds per headline query on the benchmark tables; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leafstack.plans.catalog import QUERIES  # noqa: E402
from leafstack.runtime import local_session  # noqa: E402

HEADLINE = (
    "B13_full_search", "B3_text_and", "B8_date_range_join", "C1_items_left_text", "G1_stable_multi_sort", "G3_latest_k",
    "I17_highlight_single", "H1_reachable", "H2_preorder_paths", "H4_redirect_chains", "F1_sibling_positions", "F2_unique_names",
    "D5_children_lists", "G4_sort_children", "L11_all_checks", "D1_book_totals", "L3_move_items", "L8_delete_items",
    "A13_export_manifest", "A11_import_merge", "J1_fast_text", "J1_full_text", "J2_references", "J6_page_metadata",
    "J9_externalised_pages", "H6_inlined_frames", "C11_refresh_classes", "D3_fingerprints", "A2_shard_merge", "N1_incremental_index",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from civicgrid.catalogue import QUERIES
from civicgrid.session import local_session

HEADLINE = [
    "city_topic_counts", "quality_profile", "activity_timeline_daily", "daily_summary_pivot", "outclick_top", "traffic_by_day", "top_cities_per_country", "keyword_search", "pair_states", "done_pairs",
    "attribution_with_remainder", "search_union_dedup", "upsert_merge", "history_diff", "candidate_pairs", "sitemap_groups", "ledger_rollup", "dup_candidates_url", "page_scores", "window_sessions",
    "dup_candidates_fuzzy", "saved_pairs", "mention_scan", "upserted_records",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up isn't the queries'
    took = {}
    for name in names:
        best = None
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - begun)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Bench: headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and then ``$BENCH_RUNS`` times into a no-op
sink; the median counts.  ``$BENCH_QUERIES=all`` runs every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plumbline.plans import registry
from plumbline.session import local_session, release

HEADLINE = (
    "cost_by_model", "cost_by_user", "cost_by_data_source", "cost_by_group", "cost_kpi", "cost_daily_dense", "llm_usage",
    "org_metrics", "period_compare", "daily_activity", "locf_nonzero", "top_tables", "table_pairs", "top_users",
    "diagnosis_counts", "execution_summary", "usage_stats", "feedback_attribution", "snippet_usage", "event_dedupe",
    "f_groups", "f_contains", "f_store", "f_multi_search", "c_cartesian_group", "c_heatmap", "c_treemap", "c_candlestick",
    "j_semi_scope", "j_fanout", "j_suffix_match", "j_multi_left", "j_latest_by_max", "table_profile", "schema_drift",
    "catalog_sync", "stratified_pick", "retention_rank", "page", "issues", "keywords", "keyword_score", "guidance_search",
    "table_score", "cosine_topk", "html_extract", "saved_resolve",
    "snapshot_write", "column_type_infer", "r_tool_calls", "r_ordering", "quota_summary", "quota_breach",
    "stream_usage_stats", "stream_daily_cost", "incremental_index",
    "guidance_search_indexed", "page_deep", "profile_merged", "period_members", "table_pairs_bounded", "cosine_topk_codes",
    "stream_usage_windows", "doc_ordered_groups", "doc_lookup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    build = registry.builders()
    names = list(build) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "plumbline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    timed: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # building counts too: some queries write snapshots or run streams on the way
            build[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        release(spark)
        timed[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {timed[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timed.values()), 3), "unit": "sec",
                      "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()

"""Seconds per headline query into the noop sink: the median of three warm runs, and the first, cold one.

Page extraction is timed apart, as ``page_extraction``; the queries on page features read
the stored features, as an audit does.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import load_all  # noqa: E402
from checks import recipes  # noqa: E402
from checks.registry import QUERIES  # noqa: E402
from pagewarden.operators import extract  # noqa: E402
from pagewarden.session import local_session  # noqa: E402

HEADLINE = [
    "page_title", "page_word_count", "page_links", "meta_tags", "edges", "page_audit", "page_findings", "page_health",
    "checklist_issues", "site_coverage", "site_scores", "site_summary", "metadata_inventory", "issue_matrix",
    "in_degree", "in_degree_parts", "orphan_pages", "reachable_pages", "broken_summary", "sitemap_metrics",
    "term_overlap", "frequent_terms", "site_profiles", "review_summary", "daily_metric_totals", "upsert_projects",
    "project_list", "snapshot_history", "nearest_vectors_l2", "recent_job_events", "job_status",
]
RUNS = 3


def seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    work = {"page_extraction": lambda: extract.page_features(recipes.authored_pages(spark, folder))}
    work |= {name: lambda name=name: QUERIES[name](spark, folder) for name in HEADLINE}
    taken, cold = {}, {}
    for name, make in work.items():
        cold[name] = round(seconds(make), 3)  # compiles, and stores the features the first time
        taken[name] = round(statistics.median([seconds(make) for _ in range(RUNS)]), 3)
        print(name, cold[name], taken[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline queries, total of medians", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "cold_total": round(sum(cold.values()), 3), "cold": cold,
             "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

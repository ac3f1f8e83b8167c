"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lemmaforge.plans import QUERIES  # noqa: E402
from lemmaforge.session import build_session  # noqa: E402

HEADLINES = [
    "j00_orders_lookup_report",
    "j01_batch_match",
    "j03_redirect_closure",
    "j06_prefix_suggest",
    "v01_tokenize",
    "v02_retention",
    "v08_signals",
    "v11_run_comparison",
    "q02_capped_queue",
    "a03_representative_samples",
    "a04_markup_summary",
    "a09_template_families",
    "d02_visible_text",
    "d07_remove_subtrees",
    "r08_page_markdown",
    "n01_navigation_paths",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = build_session(cores, int(cores), os.environ.get("BENCH_MEMORY", "12g"))
    QUERIES["p02_fold_key"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    spent = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
    total = round(sum(spent.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": spent, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline-query timings.  Prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "column_links_topk",        # F2: profile + text + hash encoder + all-pairs sparse cosine + top-k
    "table_search_columns",     # F1: key-column search, top-k per query
    "overall_metrics",          # M1 + M2 over the F1 ranking
    "table_search_rows",        # F3: row-level joinability over the vector lake (block matmul)
    "table_search_rows_text",   # F3: multi-key rows of the conversation lake (hash rows, block matmul)
    "metrics_multi_k_rows",     # M3 over the F3 ranking
    "value_sample_budget",      # P2/W2 over every column of the star lake
    "multi_key_samples",        # G3 over the events lake
    "key_loss",                 # L1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    os.environ.setdefault("LAKEJOIN_MASTER", f"local[{cpus}]")
    os.environ.setdefault("LAKEJOIN_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))
    from lakejoin.session import get_spark
    from lakejoin.plans.registry import QUERIES

    spark = get_spark()
    # JVM / codegen warm-up on the smoke scale (reported, not counted)
    t = time.time()
    smoke = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(smoke):
        QUERIES["column_links_topk"](spark, smoke).collect()
    warmup = round(time.time() - t, 3)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t = time.time()
        df = QUERIES[name](spark, sf_dir)
        rows[name] = len(df.collect())
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus), "warmup_sec": warmup}))


if __name__ == "__main__":
    main()

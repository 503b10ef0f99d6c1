"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_BUDGET (seconds).
Every result is written to the noop sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from clausegrid.plans.catalog import registry
from clausegrid.session import build_session

HEADLINE = [
    "d02_due_dates", "d09_fold_obligations", "d12_due_window", "d14_alert_schedule", "d17_due_notifications",
    "s04_tab_contracts", "s04_tab_risk_flags", "s07_upsert_update", "p01_dashboard", "p05_usage_ledger", "p15_constraint_audit",
    "k02_playbook", "k03_review_queue", "k05_latest_decision", "k07_approval_gate", "st3_rate_flags_day",
    "t02_page_offsets", "t05_clauses", "t08_chunks", "c04_resolve_citations", "c09_validate_fields", "c12_coverage",
    "r01_hash_embed", "r02_dense_topk", "r03_fts_topk", "r04_fusion", "k08_align_clauses", "c01_dice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    budget = float(os.environ.get("BENCH_BUDGET", "900"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm-up
    found = registry()
    times: dict[str, float] = {}
    start = time.time()
    for name in HEADLINE:
        if time.time() - start > budget:
            break
        t = time.time()
        found[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    skipped = [n for n in HEADLINE if n not in times]
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version, "skipped": skipped}))
    spark.stop()


if __name__ == "__main__":
    main()

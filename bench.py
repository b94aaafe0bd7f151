"""Headline timings: prints one JSON line, each query cold and then warm.

A first query, not counted, starts the workers. Given tables are spread over the cores, which a
cluster's many files do by themselves. BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import checks  # noqa: E402
from attestra.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_documents", "extract_documents", "warning_similarity_documents",
    "rules_detail", "report_summary", "comparison_table", "batch_reports", "match_validation",
    "match_duplicates", "sla_summary_by_batch", "batch_acceptance", "pixel_statistics",
    "quality_verdict", "redact_json", "sanitize_conversations", "proof_tolerance",
    "manifest_typed", "checklist_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.conf.set("attestra.spread", cpus if cpus.isdigit() else "8")

    def run(name: str) -> float:
        begin = time.perf_counter()
        checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("normalize_units")
    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "cold_value": round(sum(cold.values()), 3),
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

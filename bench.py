"""Headline queries on the driver's tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from formsift.plans import catalog
from formsift.session import build_session

HEADLINE = {
    "g15_auto_format": "g15_auto_format",
    "c1_batch_duplicates": "c1_batch_duplicates",
    "c2_journal_duplicates": "c2_journal_duplicates",
    "h6_multi_view_merge": "h6_multi_view_merge",
    "h7_adjudication": "h7_adjudication",
    "d1_page_merge": "d1_page_merge",
    "b2_canonical_fields": "b2_canonical_fields",
    "d5_case_quality": "d5_case_quality",
    "d8_confusion_matrix": "d8_confusion_matrix",
    "c3_field_regions": "c3_field_regions",
    "l2_correct_texts": "l2_correct_texts",
    "h3_answers_to_fields": "h3_answers_to_fields",
    "a8_journal_export": "a8_journal_export",
    "d12_activity_per_user": "d12_activity_per_user",
    "e8_lockout": "e8_lockout",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"})
    # The first job pays for starting the JVM's compilers, not for a query.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

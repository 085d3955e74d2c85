"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from outage_spark.plans.catalog import QUERIES
from outage_spark.session import build_session

HEADLINE = (
    "outage_status",
    "outage_status_weather",
    "planned_for_requests",
    "planned_overlap",
    "planned_summary",
    "weather_asof",
    "estimate_duration",
    "hours_by_area_condition",
    "chunk_fixed",
    "chunk_separators",
    "ingest_delta",
    "html_text",
    "vector_topk",
    "vector_topk_index",
    "rag_context",
    "question_answer_pairs",
    "context_turns",
    "surrogate_id",
    "gen_history_rows",
    "stream_outage_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up costs (JVM, code generation, Python workers) are not what is compared.
    for name in ("outage_status", "vector_topk"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

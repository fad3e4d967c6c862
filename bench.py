"""Time the headline queries: second run of each into the noop sink, one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES
(comma-separated name prefixes) the queries, BENCH_RUNS the runs per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bizlake import suite  # noqa: E402

HEADLINES = [
    "Q1_company_totals", "Q1_legal_forms", "Q1_provinces", "Q2_company_detail",
    "Q3_companies_per_year", "Q3_top_contributions", "Q3_top_topics", "Q4_project_detail",
    "Q5_connected_companies", "Q5_connected_search", "Q6_companies_per_year",
    "Q6_revenue_per_year", "Q6_revenue_ranking", "Q7_project_search", "Q8_company_search",
    "E1_headquarters", "E1_activities_filtered", "E2_organization", "E2_project", "E2_topics",
    "E3_valid", "E3_errors", "E4_load_counts", "E4_organization",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = tuple(filter(None, os.environ.get("BENCH_QUERIES", "").split(",")))
    names = [n for n in suite.QUERIES if n.startswith(wanted)] if wanted else HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in names:
        for _ in range(runs):
            started = time.perf_counter()
            suite.run(name, spark, folder).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

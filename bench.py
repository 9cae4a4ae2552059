"""Headline queries, each run once to warm up and then timed three times; the median
counts. Prints one JSON line. Results go to Spark's no-op sink, so every row is computed
and none is collected."""

import json
import os
import statistics
import sys
import time

from sentrylane.plans import queries as registered
from sentrylane.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

#: query -> table, or query, whose rows it processes, for rows per second.
HEADLINE = {
    "static_rules_all": "lineitem",
    "b07_code_facts": "orders",
    "scan_whole_documents": "documents",
    "h11_scan_gate_from_text": "orders",
    "h11_scan_results": "lineitem",
    "runtime_rules_all": "events",
    "e08_e09_scores": "b04_output_rows",
    "f02_f04_f10_scheduled_actions": "b04_output_rows",
    "l04_is_blocked": "events",
    "l06_finding_cve_correlation": "b04_output_rows",
    "i01_i07_project_cves": "documents",
    "i11_dependency_check": "lineitem",
    "g12_fixed_line_pairs": "part",
    "a10_sarif_report": "static_rules_all",
}


def run(spark, name: str) -> float:
    start = time.perf_counter()
    registered.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(wanted: list[str]) -> None:
    spark = local_session("bench", CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times, rates = {}, {}
    for name, table in HEADLINE.items():
        if wanted and name not in wanted:
            continue
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        rows = registered.QUERIES[table](spark, FOLDER).count() if table in registered.QUERIES else spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
        rates[name] = round(rows / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "input_rows_per_sec": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

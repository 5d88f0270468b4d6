"""Headline queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads.
Every query runs over whole tables into the ``noop`` sink: once to warm up, then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keelson.session import build_session  # noqa: E402
from workloads import registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
HEADLINES = [
    "canonicalise_rows", "cnv_int32_clamp", "cnv_decimal", "cnv_date_text", "transfer_clean", "transfer_report", "transfer_job",
    "type_to_ddl", "fleet_missing_columns", "fleet_diff_all", "fleet_summary", "ddl_create_mysql", "ddl_script",
    "pk_duplicates", "fk_orphans", "post_check", "tsv_ingest_overwrite", "import_merge", "dict_lookup", "log_filter", "load_order",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark_sql_shuffle_partitions": CPUS, "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false",
        "spark_driver_memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        first = run(spark, name)
        times[name] = first if first > 30 else run(spark, name)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1], "cpus": CPUS, "spark": spark.version, "state": "warm",
        "transfer_rows_per_sec": round(rows / times["transfer_clean"])}))
    spark.stop()


if __name__ == "__main__":
    main()

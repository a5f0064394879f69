"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores.  ``lines_per_s`` is parsing and rolling up; the cells
read written minute tables, as users do.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from accesslens.config import SESSION, Settings
from accesslens.fixtures import event_rows, plain_lines
from accesslens.operators.parse import parse_lines
from accesslens.operators.rollup import TABLES
from accesslens.plans import cells
from accesslens.plans.cells import Scope
from accesslens.plans.store import read_tables, write_roll_up

#: Copies of the events' lines under other line numbers, so that start-up does not dominate.
COPIES = int(os.environ.get("BENCH_COPIES", "10"))


def timed(out: dict[str, float], name: str, action) -> None:
    began = time.perf_counter()
    action()
    out[name] = round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config(map=SESSION).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    times: dict[str, float] = {}
    try:
        lines = plain_lines(event_rows(spark.read.parquet(f"{sf_dir}/events.parquet")))
        copies = spark.range(COPIES).selectExpr("id as copy")
        lines.crossJoin(copies).selectExpr("value", "site", "concat(server, '-', copy) as server", "seq").repartition(int(cpus) * 2).write.parquet(f"{work}/lines")
        lines = spark.read.parquet(f"{work}/lines")
        n = lines.count()
        records = parse_lines(lines, Settings())
        timed(times, "warm_up", lambda: records.groupBy("is_valid").count().collect())
        timed(times, "parse", lambda: records.write.parquet(f"{work}/records"))
        parsed = spark.read.parquet(f"{work}/records")
        timed(times, "roll_up", lambda: write_roll_up(parsed, Settings(), f"{work}/tables"))
        tables, scope = read_tables(spark, f"{work}/tables"), Scope("shop_access_log")
        for name in TABLES:
            tables[name].count()
        nine = {
            "request_summary": lambda: cells.request_summary(tables, scope),
            "request_distribution": lambda: cells.request_distribution(tables, scope),
            "request_detail": lambda: cells.request_detail(tables, scope, "/view/1/2/3.js"),
            "ip_summary": lambda: cells.ip_summary(tables, scope, "user_ip_via_cdn"),
            "ip_distribution": lambda: cells.ip_distribution(tables, scope, "10.0.1.7"),
            "ip_detail": lambda: cells.ip_detail(tables, scope, "10.0.1.7"),
            "error_summary": lambda: cells.error_summary(tables, scope),
            "error_distribution": lambda: cells.error_distribution(tables, scope, 404),
            "error_detail": lambda: cells.error_detail(tables, scope, 404),
        }
        for name, cell in nine.items():
            timed(times, f"{name}_cold", lambda cell=cell: cell().collect())
            timed(times, name, lambda cell=cell: cell().collect())
        print(json.dumps({"metric": "total_query_seconds", "value": round(sum(v for k, v in times.items() if k != "warm_up"), 3), "unit": "sec", "queries": times, "lines": n, "lines_per_s": round(n / (times["parse"] + times["roll_up"])), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    finally:
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()

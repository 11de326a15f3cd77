"""Time the data preparation and every query; prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the number of cores.
Every step runs twice, to its last row, and the second run counts: the first one
also compiles. Queries read the fact and the order rollup that the session stored; the fact is
joined to an order side stored before, which is timed on its own.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.testdata import build, build_order_rollup, build_order_side, build_slice, raw_tables
from marketlens.plans import job
from marketlens.plans.slices import SLICES
from marketlens.session import build_session, new_table_path
from marketlens.sources.raw import RAW_SCHEMAS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))


def write_csv(spark: SparkSession) -> str:
    """The raw tables as CSV files, with every column of their schemas."""
    folder = new_table_path(spark, "raw")
    for name, df in raw_tables(spark, SF_DIR).items():
        columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_SCHEMAS[name]]
        df.select(*columns).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    return folder


def main() -> None:
    spark = build_session(
        "marketlens-bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers

    seconds: dict[str, float] = {}

    def measure(name: str, run: Callable[[], object]) -> None:
        for _ in range(2):
            start = time.perf_counter()
            run()
            seconds[name] = round(time.perf_counter() - start, 3)

    raw = write_csv(spark)
    # From CSV to all tables and checks, as the reference's preparation.
    measure("prepare_from_csv", lambda: job.prepare(spark, raw, new_table_path(spark, "prepared")).collect())
    measure("build_order_side", lambda: build_order_side(spark, SF_DIR))
    measure("build_fact", lambda: build(spark, SF_DIR))
    measure("build_order_rollup", lambda: build_order_rollup(spark, SF_DIR))
    for name in SLICES:
        measure(f"build_{name}", lambda: build_slice(spark, SF_DIR, name))
    for name, query in QUERIES.items():
        measure(name, lambda: query(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "preparation and all queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

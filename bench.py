"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. ``python bench.py
scale 10`` instead scores the event table repeated ten times with shifted time.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.queries import QUERIES
from logloom.plans.detect import detect
from logloom.sources import tables as views

HEADLINE = (
    "q_search", "q_page", "q_date_range", "k_severity", "k_by_source", "k_timeline_sampled", "v_valid", "v_errors", "v_summary",
    "c_clean_access", "c_clean_logs", "d_trailing_count", "d_reason", "d_detect_all", "j_neighbours", "y_upsert", "a_parse_reply",
    "l_window_counts",
)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def repeated(spark: SparkSession, folder: str, times: int) -> DataFrame:
    """The logs ``times`` over, each copy after the other in time."""
    logs = views.logs(spark, folder).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    shifted = F.col("timestamp") + F.make_dt_interval(F.col("_copy"))
    return logs.withColumns({"timestamp": shifted, "id": F.col("id") + F.col("_copy") * F.lit(10_000_000)}).drop("_copy")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    if sys.argv[1:2] == ["scale"]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/repeated"
        repeated(spark, folder, int(sys.argv[2])).repartition(4 * cpus).write.parquet(path)
        logs, found = spark.read.parquet(path), {"rows": spark.read.parquet(path).count()}
        for name, forest in (("rules", False), ("rules_and_forest", True)):
            begin = time.time()
            run(detect(logs, use_forest=forest))
            found[name] = round(time.time() - begin, 2)
        print(json.dumps({"metric": "detect", **found, "unit": "sec", "cpus": cpus}))
        return
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(2):
            begin = time.time()
            run(QUERIES[name](spark, folder))
            taken.append(time.time() - begin)
        times[name] = round(min(taken), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, better of two runs", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()

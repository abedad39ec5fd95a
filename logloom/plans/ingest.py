"""From a delimited file to stored logs and an import report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators.tables import append_logs, assign_ids, next_id, table_exists
from logloom.operators.validate import COLUMNS, EMPTY_FILE, NO_HEADER, NO_ROWS, Report, error_head, file_error, validate
from logloom.plans.detect import detect
from logloom.session import prepare
from logloom.sources.delimited import read_delimited

# Fixed value.
FAILED = "Upload failed. All rows were rejected due to schema or parsing errors."


def validate_file(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool | None = None) -> Report:
    """Read and validate; a file that has no rows gives a single file-level error."""
    prepare(spark)
    text = F.trim(F.replace("value", F.lit("\ufeff"), F.lit("")))
    if spark.read.text(path).filter(text != "").isEmpty():
        return file_error(spark, "file", EMPTY_FILE)
    rows = read_delimited(spark, path, sep, multi_line, COLUMNS)
    if rows is None:
        return file_error(spark, "header", NO_HEADER)
    if rows.isEmpty():
        return file_error(spark, "file", NO_ROWS)
    return validate(rows)


def as_logs(valid: DataFrame, start: int = 0) -> DataFrame:
    """Valid records as log rows with ids after ``start``."""
    return assign_ids(valid, start=start).select(*schema.LOG.fieldNames())


def import_report(report: Report, anomalies: DataFrame | None = None) -> DataFrame:
    """One row: what came in, what was rejected, and a message."""
    done = report.summary.select(
        F.col("is_valid").alias("success"),
        "total_processed",
        F.col("valid_count").alias("imported_count"),
        "rejected_count",
        "duplicate_count",
        F.when(F.col("is_valid"), F.concat(F.lit("Successfully imported "), F.col("valid_count").cast("string"), F.lit(" logs as is.")))
        .otherwise(FAILED).alias("message"),
    )
    found = F.lit(0).cast("long") if anomalies is None else anomalies.agg(F.count_if(F.col("anomaly"))).scalar()
    return done.withColumn("anomalies_detected", found)


def import_file(
    spark: SparkSession, path: str, table: str, sep: str | None = None, multi_line: bool | None = None, run_detection: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Validate a file, append its valid rows, and return report and first errors.

    Detection is off unless asked for, and then covers the imported rows only.
    """
    report = validate_file(spark, path, sep, multi_line)
    start = next_id(spark, table) if table_exists(spark, table) else 0
    logs = as_logs(report.valid, start)
    if logs.isEmpty():
        return import_report(report), error_head(report.errors)
    scored = detect(logs) if run_detection else None
    append_logs(logs if scored is None else scored, table)
    return import_report(report, scored), error_head(report.errors)

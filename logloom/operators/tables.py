"""Keyed upserts, deletes with their dependants, and stored tables by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.layouts import explained
from logloom.session import staged

DAY = "dt"


def with_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn(DAY, F.to_date("timestamp"))


def append_logs(logs: DataFrame, path: str) -> None:
    """Append to a log table laid out by day.

    The rebalance hint gathers small days and splits large ones, so a day gets
    neither a file per task nor one oversized file.
    """
    with_day(logs).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def assign_ids(rows: DataFrame, order: str = "row_no", start: int = 0) -> DataFrame:
    """Log rows with ``id``: the stable row number after the last id in use."""
    return rows.withColumn("id", F.col(order) + F.lit(start).cast("long"))


def next_id(spark: SparkSession, path: str) -> int:
    """The largest id of a stored table, 0 when empty."""
    return spark.read.parquet(path).agg(F.max("id")).first()[0] or 0


def newest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the one with the largest ``order``; partially aggregated."""
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return kept.select("_row.*")


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Current rows with those of equal key replaced, and new ones added.

    Give ``order`` when a key may come more than once; the largest one counts.
    Columns only one side has are null on the other.
    """
    fresh = newest(incoming, key, order) if order is not None else incoming
    kept = current.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def delete(current: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids`` (a short list, or a frame of any size)."""
    if isinstance(ids, list):
        return current.filter(~F.col(key).isin(ids))
    return current.join(ids.select(key), key, "left_anti")


def delete_count(current: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """One row ``deleted_count``."""
    return current.join(ids.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("deleted_count"))


def cascade(logs: DataFrame, anomalies: DataFrame, explanations: DataFrame, uuids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the logs in ``uuids.id`` and all that hangs on them."""
    gone_logs = uuids.select("id").distinct()
    gone_anomalies = anomalies.join(gone_logs.withColumnRenamed("id", "log_id"), "log_id", "left_semi").select(F.col("id").alias("anomaly_id")).distinct()
    return (
        logs.join(gone_logs, "id", "left_anti"),
        anomalies.join(gone_logs.withColumnRenamed("id", "log_id"), "log_id", "left_anti"),
        explanations.join(gone_anomalies, "anomaly_id", "left_anti"),
    )


def cleared(table: DataFrame) -> DataFrame:
    """An empty frame with the table's schema."""
    return table.sparkSession.createDataFrame([], table.schema)


def explained_anomalies(anomalies: DataFrame, logs: DataFrame) -> DataFrame:
    """Anomaly records with the explanation of their log, where it has one."""
    texts = logs.filter(explained()).select(F.col("uuid").alias("log_id"), "ai_explanation", "ai_root_cause", "ai_next_step", "ai_model")
    return anomalies.join(texts, "log_id")


# --- Stored tables laid out by day: only the days a change touches are rewritten


NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _on(days: set) -> Column:
    """Rows of the given days, of which one may be null."""
    dated = F.col(DAY).isin([day for day in days if day is not None])
    return dated | F.col(DAY).isNull() if None in days else F.coalesce(dated, F.lit(False))


def _days(table: DataFrame, keys: DataFrame, key: str) -> set:
    """The days that hold any of the keys, null included; one value per day of the table at most."""
    return {row[0] for row in table.join(keys.select(key), key, "left_semi").select(DAY).distinct().collect()}


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, days: set) -> None:
    """Replace the given days by ``rows``, which may have been read from them.

    The new rows are staged before anything is replaced, so a lost executor
    costs a recomputation and never data. Days left without rows are removed.
    """
    fresh = staged(rows)
    left = {row[0] for row in fresh.select(DAY).distinct().collect()}
    fresh.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    for day in days - left:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={NO_DAY if day is None else day}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def upsert_table(
    spark: SparkSession, path: str, incoming: DataFrame, key: str = "id", order: Column | None = None, moves: bool = True,
) -> None:
    """Upsert into a stored table, made when absent; running it twice gives the same table.

    A row may come with another day than it is stored under, so all keys are
    looked through. With ``moves`` False the caller says that days stay, and only
    the incoming days are read and rewritten.
    """
    if not table_exists(spark, path):
        fresh = newest(incoming, key, order) if order is not None else incoming
        fresh.hint("rebalance", DAY).write.partitionBy(DAY).parquet(path)
        return
    fresh = staged(newest(incoming, key, order) if order is not None else incoming)
    current = spark.read.parquet(path)
    days = {row[0] for row in fresh.select(DAY).distinct().collect()}
    if moves:
        days |= _days(current, fresh, key)
    touched = current.filter(_on(days))
    _rewrite(spark, path, upsert(touched, fresh, key), days)


def delete_from_table(spark: SparkSession, path: str, ids: DataFrame, key: str = "id") -> int:
    """Delete by key from a stored table and return how many rows went."""
    current = spark.read.parquet(path)
    days = _days(current, ids, key)
    touched = current.filter(_on(days))
    count = delete_count(touched, ids, key).first()[0]
    if count:
        _rewrite(spark, path, delete(touched, ids, key), days)
    return count


def clear_table(spark: SparkSession, path: str) -> int:
    """Empty a stored table, keeping its schema, and return how many rows went."""
    table = spark.read.parquet(path)
    count, empty = table.count(), cleared(table.drop(DAY))
    empty.write.mode("overwrite").parquet(path)
    return count


def first_existing(spark: SparkSession, candidates: tuple[str, ...], default: str = "logs") -> str:
    """The first of the catalog tables that exists."""
    return next((name for name in candidates if spark.catalog.tableExists(name)), default)

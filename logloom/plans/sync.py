"""Pushing logs, anomalies and explanations to the three target tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.explorer import first_anomalies
from logloom.operators.layouts import (
    LOGS, clean_metrics, clean_records, cloud_anomalies, cloud_explanations, cloud_logs, explained, stored,
)
from logloom.operators.published import Store
from logloom.operators.tables import DAY, with_day
from logloom.plans.detect import detect
from logloom.plans.ingest import as_logs, validate_file
from logloom.session import staged

TARGETS = ("logs", "anomalies", "ai_analysis")


@dataclass(frozen=True)
class Payload:
    """The records for the three targets; ``logs`` is None when not sent.

    Anomalies and explanations carry the day of their log, by which they are stored.
    """

    logs: DataFrame | None
    anomalies: DataFrame
    explanations: DataFrame


def sync_all(logs: DataFrame, now: Column, layout: str = LOGS, narrow: bool = False) -> Payload:
    """All logs cleaned, and an anomaly and an explanation record for every anomaly."""
    full = with_day(stored(logs))
    return Payload(
        clean_records(cloud_logs(full, now), now, layout),
        cloud_anomalies(full, now, narrow, (DAY,)),
        cloud_explanations(full.filter(F.col("anomaly")), now, (DAY,)),
    )


def sync_one(logs: DataFrame, log_id: int, now: Column, layout: str = LOGS) -> Payload:
    """One log; its explanation only when it has one."""
    one = stored(logs.filter(F.col("id") == log_id))
    every = sync_all(one, now, layout)
    return Payload(every.logs, every.anomalies, cloud_explanations(with_day(one).filter(F.col("anomaly") & explained()), now, (DAY,)))


def feed_explanations(logs: DataFrame, now: Column) -> Payload:
    """Anomalies and explanations only."""
    every = sync_all(logs, now)
    return Payload(None, every.anomalies, every.explanations)


def kept(payload: Payload) -> Payload:
    """The payload with its records stored: one that is sent more than once is made once."""
    return Payload(payload.logs and staged(payload.logs), staged(payload.anomalies), staged(payload.explanations))


def counts(payload: Payload) -> DataFrame:
    """One row: how many records go to each target."""
    parts = [payload.logs, payload.anomalies, payload.explanations]
    rows = [
        part.select(F.lit(name).alias("target"))
        for name, part in zip(TARGETS, parts) if part is not None
    ]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    return union.agg(
        F.count_if(F.col("target") == "logs").alias("logs_synced"),
        F.count_if(F.col("target") == "anomalies").alias("anomalies_synced"),
        F.count_if(F.col("target") == "ai_analysis").alias("ai_synced"),
    )


#: The targets from the top down, with the column that names the row above.
CHAIN = (("logs", None), ("anomalies", "log_id"), ("ai_analysis", "anomaly_id"))
#: Columns of anomalies that an older, narrow target lacks.
WIDE = ("anomaly_score", "reason", "detected_by", "created_at")


def write(spark: SparkSession, payload: Payload, root: str, moves: bool = True, step: Callable[[str], None] | None = None) -> int:
    """Upsert the payload into the tables under ``root`` as one change; returns the version.

    Readers see all three tables before or after it, never a mix; see
    ``published``. Every record is stored under its log's day, null where that is
    unknown, so that sending it again finds it there. A target of anomalies in the
    narrow form gets them in that form. ``moves`` as in ``Store.upsert``.
    """
    store, parts = Store(spark, root, step=step), {}
    for name, part in zip(TARGETS, (payload.logs, payload.anomalies, payload.explanations)):
        if part is not None:
            parts[name] = part if DAY in part.columns else part.withColumn(DAY, F.substring("timestamp", 1, 10).try_cast("date"))
    known = store.read("anomalies")
    if known is not None and not set(known.columns) & set(WIDE):
        parts["anomalies"] = parts["anomalies"].drop(*WIDE)
    return store.upsert(parts, moves=moves)


def target(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """One of the tables under ``root``, as last published."""
    return Store(spark, root).read(name)


def delete_logs(spark: SparkSession, root: str, uuids: DataFrame) -> dict[str, int]:
    """Delete logs by ``id`` with their anomalies and explanations, as one change; returns the counts."""
    return Store(spark, root).cascade(uuids, CHAIN)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch: int = 500) -> None:
    """Append records to a database table in batches; the driver class must be on the class path."""
    rows.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties or {})


def seed(
    spark: SparkSession, path: str, root: str, now: Column, threshold: int = 50, explain=None, sample: int = 3,
) -> DataFrame:
    """Validate a file, score it, load the three targets, and return one row of counts.

    ``explain`` may attach explanations: it gets the scored logs and the first
    ``sample`` anomalies in time order. Only explained anomalies get an
    explanation record.
    """
    report = validate_file(spark, path)
    scored = stored(staged(detect(as_logs(report.valid), threshold)))
    if explain is not None:
        scored = stored(staged(explain(scored, first_anomalies(scored, sample))))
    every = sync_all(scored, now)
    told = with_day(scored).filter(F.col("anomaly") & explained())
    payload = Payload(every.logs, every.anomalies, cloud_explanations(told, now, (DAY,)))
    write(spark, payload, root)
    sent = counts(payload).first().asDict()
    return report.summary.select(
        F.col("total_processed").alias("total_logs"),
        F.col("valid_count").alias("valid_logs"),
        F.col("rejected_count").alias("rejected_logs"),
        *[F.lit(n).alias(name) for name, n in sent.items()],
    )


def cleaning_report(logs: DataFrame, now: Column, layout: str = LOGS) -> DataFrame:
    return clean_metrics(clean_records(cloud_logs(logs, now), now, layout))

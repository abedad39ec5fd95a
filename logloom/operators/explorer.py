"""Search, filter, sort and page over logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHED = ("message", "endpoint", "ip_address", "event_type", "source")
SORTABLE = (
    "id", "timestamp", "source", "event_type", "severity", "status_code", "anomaly", "anomaly_score", "created_at",
)


def search(logs: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive substring in any searched column; ``%`` and ``_`` are wildcards."""
    text = (text or "").strip()
    if not text:
        return logs
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return logs.filter(hit)


def equals(logs: DataFrame, severity: str | None = None, source: str | None = None) -> DataFrame:
    severity, source = (severity or "").strip().upper(), (source or "").strip()
    if severity and severity != "ALL":
        logs = logs.filter(F.col("severity") == severity)
    if source and source != "ALL":
        logs = logs.filter(F.col("source") == source)
    return logs


def anomalies_only(logs: DataFrame, flag: str | bool = True) -> DataFrame:
    return logs.filter(F.col("anomaly")) if str(flag).lower() in ("true", "1", "yes") else logs


def _day(text: str | None) -> datetime | None:
    try:
        return datetime.strptime((text or "").strip(), "%Y-%m-%d")
    except ValueError:
        return None


def date_range(logs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """From the first second of ``start`` to the last whole second of ``end``; unreadable days are ignored.

    A table partitioned by ``dt`` is pruned to the days asked for.
    """
    first, last = _day(start), _day(end)
    if first:
        logs = logs.filter(F.col("timestamp") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        logs = logs.filter(F.col("timestamp") <= F.lit(last.replace(hour=23, minute=59, second=59)).cast("timestamp_ntz"))
    if "dt" in logs.columns:
        logs = logs.filter(F.col("dt") >= F.lit(first.date())) if first else logs
        logs = logs.filter(F.col("dt") <= F.lit(last.date())) if last else logs
    return logs


def find(
    logs: DataFrame, text: str | None = None, severity: str | None = None, source: str | None = None,
    anomaly_only: str | bool = False, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """All explorer filters together."""
    return search(date_range(anomalies_only(equals(logs, severity, source), anomaly_only), start, end), text)


def ordering(sort_by: str = "timestamp", direction: str = "desc") -> list[Column]:
    """Nulls first ascending, last descending; ``id`` settles ties the same way."""
    name = sort_by if sort_by in SORTABLE else "timestamp"
    if direction == "asc":
        return [F.col(name).asc_nulls_first(), F.col("id").asc()]
    return [F.col(name).desc_nulls_last(), F.col("id").desc()]


def sort(logs: DataFrame, sort_by: str = "timestamp", direction: str = "desc") -> DataFrame:
    return logs.orderBy(*ordering(sort_by, direction))


def page(
    logs: DataFrame, number: int = 1, per_page: int = 20, sort_by: str = "timestamp", direction: str = "desc",
) -> DataFrame:
    """One page; Spark keeps only the first ``number * per_page`` rows of each task.

    For deep pages use :func:`page_after`.
    """
    return sort(logs, sort_by, direction).offset(max(number - 1, 0) * per_page).limit(per_page)


def page_after(logs: DataFrame, timestamp: datetime | None, log_id: int, per_page: int = 20, direction: str = "desc") -> DataFrame:
    """The page that follows the given row in timestamp order, at the same cost at any depth.

    Rows without a timestamp stand where :func:`ordering` puts them; such a row's place is None and its id.
    """
    time, number = F.col("timestamp"), F.col("id")
    bound, log_id = F.lit(timestamp).cast("timestamp_ntz"), F.lit(log_id).cast("long")
    if direction == "asc":
        beyond = number > log_id
        ahead = time.isNotNull() | beyond if timestamp is None else (time >= bound) & ((time > bound) | beyond)
    else:
        beyond = number < log_id
        ahead = time.isNull() & beyond if timestamp is None else ((time <= bound) & ((time < bound) | beyond)) | time.isNull()
    return sort(logs.filter(ahead), "timestamp", direction).limit(per_page)


def page_info(logs: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """One row: total, page, pages, per_page, has_next, has_prev."""
    pages = F.ceil(F.col("total") / per_page).cast("long")
    return logs.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).alias("page"),
        pages.alias("pages"),
        F.lit(per_page).alias("per_page"),
        (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def by_id(logs: DataFrame, log_id: int) -> DataFrame:
    return logs.filter(F.col("id") == log_id)


def by_ids(logs: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Rows of a short list of ids, or of an id table of any length."""
    if isinstance(ids, DataFrame):
        return logs.join(ids.select("id"), "id", "left_semi")
    return logs.filter(F.col("id").isin(list(ids)))


def recent_anomalies(logs: DataFrame, limit: int = 6) -> DataFrame:
    return logs.filter(F.col("anomaly")).orderBy(*ordering()).limit(limit)


def sources(logs: DataFrame) -> DataFrame:
    return logs.select("source").distinct().orderBy("source")


def first_anomalies(logs: DataFrame, limit: int = 3) -> DataFrame:
    """The first anomalies in time order, for a sample of explanations."""
    return logs.filter(F.col("anomaly")).orderBy(*ordering("timestamp", "asc")).limit(limit)

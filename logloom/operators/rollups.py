"""The dashboard from sums per cell of a published log table, without reading the logs.

``cell_sums`` is the rollup of such a table (see ``published``): for every cell,
counts by minute, by source and by severity. They are made when a change writes
the cell, merged when they are read, and as fresh as the rows of their version.
A cell has at most as many sums as rows, and usually far fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators import stats
from logloom.operators.explorer import recent_anomalies
from logloom.operators.published import Store, Version

LOGS = "logs"
_CELL = ("_p_day", "_p_cell")
_SUMS = ("total", "anomalies", "explained")


def cell_sums(rows: DataFrame) -> DataFrame:
    """Rows, anomalies and explanations per cell, by minute, by source and by severity; nulls are groups of their own.

    One pass, aggregated before the shuffle. Of the columns only five are read.
    """
    told = F.col("ai_explanation").isNotNull() if "ai_explanation" in rows.columns else F.lit(False)
    parts = ("minute", "source", "severity")
    narrow = rows.select(
        *_CELL, F.date_trunc("MINUTE", "timestamp").cast("timestamp_ntz").alias("minute"), "source", "severity", "anomaly", told.alias("told"),
    )
    sums = narrow.groupingSets([[F.col(c) for c in (*_CELL, part)] for part in parts], *_CELL, *parts).agg(
        F.when(F.grouping("minute") == 0, "minute").when(F.grouping("source") == 0, "source").otherwise("severity").alias("kind"),
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("anomaly")).alias("anomalies"), F.count_if(F.col("told")).alias("explained"),
    )
    return sums.withColumn("day", F.col("_p_day"))


def store(spark: SparkSession, root: str, **more) -> Store:
    """A store whose table of logs is summed up with every change."""
    return Store(spark, root, rollups={LOGS: cell_sums}, **more)


def _by(sums: DataFrame, kind: str, *, of: str | None = None) -> DataFrame:
    return sums.filter(F.col("kind") == kind).groupBy(of or kind).agg(*[F.sum(c).alias(c) for c in _SUMS])


def totals(sums: DataFrame) -> DataFrame:
    """As ``stats.totals``."""
    level = F.col("severity")
    count = lambda name, rows=F.lit(True): F.coalesce(F.sum(F.when(rows, F.col(name))), F.lit(0).cast("long"))
    return stats.rates(sums.filter(F.col("kind") == "severity").agg(
        count("total").alias("total_logs"),
        count("anomalies").alias("total_anomalies"),
        count("anomalies", level == "CRITICAL").alias("critical_anomalies"),
        count("total", level.isin("ERROR", "CRITICAL")).alias("failed"),
        count("explained").alias("ai_analyses_count"),
    ))


def severity_distribution(sums: DataFrame) -> DataFrame:
    """As ``stats.severity_distribution``."""
    counts = sums.filter(F.col("kind") == "severity").agg(
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("total"))), F.lit(0).cast("long")).alias(s) for s in schema.SEVERITIES])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in schema.SEVERITIES])))


def anomalies_by_source(sums: DataFrame) -> DataFrame:
    """As ``stats.anomalies_by_source``."""
    counts = _by(sums, "source").filter("anomalies > 0").select("source", F.col("anomalies").alias("n"))
    return counts.orderBy(F.col("n").desc(), "source")


def timeline(sums: DataFrame, dated: bool = False) -> DataFrame:
    """As ``stats.timeline``."""
    return stats.labelled(_by(sums, "minute").filter(F.col("minute").isNotNull()), dated)


def timeline_sampled(sums: DataFrame, buckets: int = stats.MAX_BUCKETS) -> DataFrame:
    """As ``stats.timeline_sampled``."""
    return stats.sampled(timeline(sums), buckets)


def sources(sums: DataFrame) -> DataFrame:
    """As ``explorer.sources``."""
    return _by(sums, "source").select("source").orderBy("source")


def recent(logs: Store, limit: int = 6, version: Version | None = None) -> DataFrame:
    """As ``explorer.recent_anomalies``; reads only the newest days that hold so many, at most ``limit`` of them.

    Logs are stored under the day of their time, those without a time under none, which comes last.
    """
    now = version or logs.version()
    days = _by(logs.rollup(LOGS, now), "severity", of="day").filter("anomalies > 0")
    newest = Window.orderBy((F.col("day") == "none").asc(), F.col("day").desc())  # one row per day
    later = F.sum("anomalies").over(newest) - F.col("anomalies")
    wanted = {r.day for r in days.withColumn("later", later).filter(F.col("later") < limit).select("day").collect()}
    return recent_anomalies(logs.read(LOGS, now, {cell for cell in now.cells.get(LOGS, {}) if cell[0] in wanted}), limit)


def dashboard(logs: Store) -> dict[str, DataFrame]:
    """All parts of ``stats.dashboard`` at one version of the table."""
    now = logs.version()
    sums = logs.rollup(LOGS, now)
    return {
        "totals": totals(sums),
        "severity_distribution": severity_distribution(sums),
        "anomalies_by_source": anomalies_by_source(sums),
        "timeline": timeline_sampled(sums),
        "timeline_full": timeline(sums),
        "recent_anomalies": recent(logs, version=now),
        "sources": sources(sums),
    }

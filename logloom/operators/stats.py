"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators.explorer import recent_anomalies, sources

MAX_BUCKETS = 25


def totals(logs: DataFrame) -> DataFrame:
    """One row of counts and rates, all zero for an empty table."""
    explained = F.col("ai_explanation").isNotNull() if "ai_explanation" in logs.columns else F.lit(False)
    counted = logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_if(F.col("anomaly")).alias("total_anomalies"),
        F.count_if(F.col("anomaly") & (F.col("severity") == "CRITICAL")).alias("critical_anomalies"),
        F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).alias("failed"),
        F.count_if(explained).alias("ai_analyses_count"),
    )
    return rates(counted)


def rates(counted: DataFrame) -> DataFrame:
    """The totals from the counts of rows, anomalies, critical ones, failures and explanations."""

    def rate(part: str):
        share = F.coalesce(F.try_divide(F.col(part), F.col("total_logs")), F.lit(0.0))
        return F.bround(share * 100, 1)

    return counted.select(
        "total_logs", "total_anomalies", "critical_anomalies", "ai_analyses_count",
        rate("failed").alias("error_rate"),
        rate("total_anomalies").alias("anomaly_rate"),
    )


def severity_distribution(logs: DataFrame) -> DataFrame:
    """A count for each of the four severities, also when it is zero."""
    counts = logs.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in schema.SEVERITIES])
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in schema.SEVERITIES])
    return counts.select(F.inline(pairs))


def anomalies_by_source(logs: DataFrame) -> DataFrame:
    counts = logs.filter(F.col("anomaly")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "source")


def timeline(logs: DataFrame, dated: bool = False) -> DataFrame:
    """Logs and anomalies per minute. The label leaves the year out; ``dated`` keeps it.

    Rows are counted per minute, and only the minutes are written as labels.
    """
    minutes = (
        logs.filter(F.col("timestamp").isNotNull())
        .groupBy(F.date_trunc("MINUTE", "timestamp").alias("minute"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("anomaly")).alias("anomalies"))
    )
    return labelled(minutes, dated)


def labelled(minutes: DataFrame, dated: bool = False) -> DataFrame:
    """Counts per minute added up by the minute's label."""
    label = "yyyy-MM-dd HH:mm" if dated else "MM-dd HH:mm"
    named = minutes.groupBy(F.date_format("minute", label).alias("bucket"))
    return named.agg(F.sum("total").alias("total"), F.sum("anomalies").alias("anomalies"))


def timeline_sampled(logs: DataFrame, buckets: int = MAX_BUCKETS) -> DataFrame:
    """Every n-th bucket when there are more than ``buckets``; the others are left out."""
    return sampled(timeline(logs), buckets)


def sampled(line: DataFrame, buckets: int = MAX_BUCKETS) -> DataFrame:
    """Every n-th bucket of a timeline; the window sees at most one row per minute of a year."""
    ranked = line.select(
        "*",
        F.row_number().over(Window.orderBy("bucket")).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("buckets"),
    )
    step = F.when(F.col("buckets") > buckets, F.call_function("div", F.col("buckets"), F.lit(buckets)) + 1).otherwise(1)
    return ranked.filter((F.col("place") - 1) % step == 0).select("bucket", "total", "anomalies").orderBy("bucket")


def score_bands(logs: DataFrame) -> DataFrame:
    """Each log's display colour."""
    score = F.col("anomaly_score")
    return logs.withColumn("band", F.when(score >= 70, "red").when(score >= 50, "amber").otherwise("green"))


def dashboard(logs: DataFrame) -> dict[str, DataFrame]:
    """All parts of the dashboard, one small frame each. Give it a stored scored table, which every part reads."""
    return {
        "totals": totals(logs),
        "severity_distribution": severity_distribution(logs),
        "anomalies_by_source": anomalies_by_source(logs),
        "timeline": timeline_sampled(logs),
        "timeline_full": timeline(logs),
        "recent_anomalies": recent_anomalies(logs),
        "sources": sources(logs),
    }

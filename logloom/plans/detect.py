"""The detection job: profile, trailing counts, forest, signals, score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators import forest
from logloom.operators.profile import Profile, counts_of, notable_ips, take_profile, with_location
from logloom.operators.signals import with_score, with_signals
from logloom.operators.skew import lookup
from logloom.operators.trailing import blocks, burst_threshold, histogram, with_trailing_count
from logloom.session import prepare, staged

RESULT = ("anomaly", "anomaly_score", "anomaly_reason")


def rule_features(logs: DataFrame, profile: Profile, counted: DataFrame) -> DataFrame:
    """Logs with location, trailing count and ip counts."""
    placed = with_trailing_count(with_location(logs), counted)
    ips = notable_ips(profile.table)
    return lookup(placed, ips, "ip_address", "id", profile.sizes.get("ip", 0), profile.total)


def forest_features(rows: DataFrame, profile: Profile) -> DataFrame:
    """``rows`` plus source and event counts and the seven forest features."""
    for kind, key in (("source", "source"), ("event", "event_type")):
        found = counts_of(profile.table, kind, key).withColumn(f"n_{kind}", F.col("n"))
        rows = lookup(rows, found, key, "id", profile.sizes.get(kind, 0), profile.total)
    return rows.withColumns(forest.feature_columns())


def features(
    logs: DataFrame, profile: Profile, use_forest: bool = True, contamination: float = schema.CONTAMINATION,
    settings: forest.Settings = forest.Settings(),
) -> DataFrame:
    """All inputs of the signals: ``rule_features``, ``burst_threshold`` and ``is_outlier``.

    The block counts serve both the threshold and the rows, so they are staged.
    So are the rows when there is a forest, which reads them twice (sample,
    score), instead of repeating the joins.
    """
    counted = staged(blocks(logs))
    threshold = burst_threshold(histogram(counted)).first()["threshold"]
    rows = rule_features(logs, profile, counted).withColumn("burst_threshold", F.lit(float(threshold)))
    if not use_forest or profile.total < forest.MIN_ROWS:
        return rows.withColumn("is_outlier", F.lit(False))
    stored = staged(forest_features(rows, profile))
    return forest.with_outliers(stored, profile.total, contamination, settings).select(*rows.columns, "is_outlier")


def detect(
    logs: DataFrame, threshold: int = schema.THRESHOLD, contamination: float = schema.CONTAMINATION,
    weights: Mapping[str, int] | None = None, use_forest: bool = True, settings: forest.Settings = forest.Settings(),
) -> DataFrame:
    """Logs with ``anomaly``, ``anomaly_score`` and ``anomaly_reason``.

    ``logs`` needs a unique ``id``. Earlier results in those columns are replaced.
    """
    logs = logs.drop(*RESULT)
    prepare(logs.sparkSession)
    profile = take_profile(logs)
    rows = features(logs, profile, use_forest, contamination, settings)
    return with_score(rows, profile, threshold, weights).select(*logs.columns, *RESULT)


def signals(logs: DataFrame, weights: Mapping[str, int] | None = None, use_forest: bool = True) -> DataFrame:
    """One row per log and triggered signal: ``id, place, code, points, text``."""
    profile = take_profile(logs)
    found = with_signals(features(logs, profile, use_forest), profile, weights)
    return found.select("id", F.posexplode("signals").alias("place", "s")).select("id", "place", "s.*")


def detect_table(spark: SparkSession, source: str, target: str, threshold: int = schema.THRESHOLD) -> DataFrame:
    """Score a stored table into ``target`` and return one row ``total_logs, anomalies``."""
    scored = detect(spark.read.parquet(source), threshold)
    writer = scored.write.mode("overwrite")
    (writer.partitionBy("dt") if "dt" in scored.columns else writer).parquet(target)
    return spark.read.parquet(target).agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("anomaly")).alias("anomalies")
    )

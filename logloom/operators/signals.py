"""The rule signals, the score and its reason: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators.profile import MIN_404, MIN_HOPS, Profile


def _signals(weights: Mapping[str, int] | None, profile: Profile) -> list[tuple[str, Column, Column, Column]]:
    """``(code, condition, points, text)`` in the order of the reason text."""
    given = dict(weights) if weights else {}

    def points(name: str) -> Column:
        return F.lit(given.get(name, schema.WEIGHTS[name]))

    location, source, event = F.col("location"), F.col("source"), F.col("event_type")
    status, severity, message = F.col("status_code"), F.col("severity"), F.col("message")
    ip = F.nullif("ip_address", F.lit(""))
    rare_place = ~location.isin(*profile.common_locations) if profile.common_locations else F.lit(True)
    rare_event = event.isNull() | ~event.isin(*profile.common_events) if profile.common_events else F.lit(True)
    bot = F.coalesce(F.lower(source).contains("bot"), F.lit(False)) | F.coalesce(
        F.lower(message).contains("agent: bot"), F.lit(False)
    )
    harmful = (F.lower(location) == "north korea") | (status >= 400)
    repeated = (status == 404) & ip.isNotNull() & (F.col("n_404") >= MIN_404)

    # Signal codes and texts.
    return [
        (
            "HIGH_RISK_GEO",
            location.isNotNull() & (F.lower(location).isin(*schema.HIGH_RISK_LOCATIONS) | rare_place),
            points("geo_high_risk"),
            F.format_string("originates from high-risk/anomalous geographic location '%s'", location),
        ),
        (
            "GEO_SPOOFING_IP",
            ip.isNotNull() & (F.col("n_locations") >= MIN_HOPS),
            points("geo_spoofing_ip"),
            F.format_string(
                "IP address %s exhibited rotating geographic hops across %d distinct countries", ip, F.col("n_locations")
            ),
        ),
        (
            "MALICIOUS_BOT_ACTION",
            bot & event.isin("DELETE", "PUT") & harmful,
            points("bot_malicious_action"),
            F.format_string("automated Bot client attempted destructive HTTP %s operation", event),
        ),
        ("CRITICAL_SEVERITY", severity == "CRITICAL", points("severity_critical"), F.lit("has CRITICAL severity level")),
        ("ERROR_SEVERITY", severity == "ERROR", points("severity_error"), F.lit("has ERROR severity level")),
        (
            "FREQUENCY_BURST",
            F.col("n_5m") >= F.col("burst_threshold"),
            points("high_frequency"),
            F.format_string(
                "occurred during an unusually high burst of %d events in 5 minutes from '%s'", F.col("n_5m"), source
            ),
        ),
        (
            "HTTP_AUTH_DENIED",
            status.isin(401, 403),
            points("status_auth_fail"),
            F.format_string("returned authentication/authorization denial HTTP %d", status),
        ),
        (
            "REPEATED_404",
            repeated,
            points("status_repeated_404"),
            F.format_string("part of a repeated 404 pattern (%d occurrences from IP %s)", F.col("n_404"), ip),
        ),
        (
            "HTTP_5XX_ERROR",
            status >= 500,
            points("status_500_plus"),
            F.format_string("returned HTTP server error %d", status),
        ),
        (
            "RARE_EVENT",
            rare_event,
            points("rare_event"),
            F.format_string("is an unusual event type '%s' (occurring in <=1%% of logs)", F.coalesce(event, F.lit("None"))),
        ),
        (
            "ISOLATION_FOREST",
            F.col("is_outlier"),
            points("isolation_forest"),
            F.lit("flagged as statistical outlier by Isolation Forest"),
        ),
    ]


def with_signals(featured: DataFrame, profile: Profile, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``featured`` plus ``signals``: the triggered ``(code, points, text)`` in order."""
    found = [
        F.when(condition, F.struct(F.lit(code).alias("code"), points.alias("points"), text.alias("text")))
        for code, condition, points, text in _signals(weights, profile)
    ]
    return featured.withColumn("signals", F.array_compact(F.array(*found)))


def with_score(
    featured: DataFrame, profile: Profile, threshold: int = schema.THRESHOLD, weights: Mapping[str, int] | None = None
) -> DataFrame:
    """``featured`` plus anomaly flag, score (0-100) and reason."""
    rules = _signals(weights, profile)
    total = F.lit(0)
    for _, condition, points, _ in rules:
        total = total + F.when(condition, points).otherwise(0)
    texts = F.concat_ws(", ", *[F.when(condition, text) for _, condition, _, text in rules])
    score = F.least(F.lit(100.0), F.col("_sum").cast("double"))
    shown = F.format_string("%.0f", F.col("anomaly_score"))
    flagged = F.concat(F.lit("Flagged with anomaly score "), shown, F.lit("/100 "))
    reason = (
        F.when(
            F.col("anomaly") & (F.col("_texts") != ""),
            F.concat(flagged, F.lit("because the log "), F.col("_texts"), F.lit(".")),
        )
        .when(F.col("anomaly"), F.concat(flagged, F.lit(f"exceeding threshold of {threshold}.")))
        .otherwise(F.concat(F.lit("Normal log activity (score: "), shown, F.lit("/100).")))
    )
    return (
        featured.withColumns({"_sum": total, "_texts": texts})
        .withColumn("anomaly_score", score)
        .withColumn("anomaly", F.col("anomaly_score") >= threshold)
        .withColumn("anomaly_reason", reason)
        .drop("_sum", "_texts")
    )

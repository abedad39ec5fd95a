"""Cleaning loose records and projecting logs onto the target layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.clean import json_text, normalize_ip, normalize_status
from logloom.functions.text import capitalized, filled, iso, strip
from logloom.functions.times import iso_utc, normalize_time

ACCESS, LOGS = "access", "logs"
LAYOUTS = {
    ACCESS: ("id", "timestamp", "ip_address", "event_type", "status_code", "user_agent", "session_id", "location"),
    LOGS: ("id", "timestamp", "source", "event_type", "severity", "status_code", "ip_address", "message"),
}


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped name that is the same on every run."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def stored(logs: DataFrame) -> DataFrame:
    """Logs with all columns of a stored log; a missing uuid is derived from the row."""
    absent = {n: F.lit(None).cast(t) for n, t in schema.STORED_EXTRAS.items() if n not in logs.columns}
    full = logs.withColumns(absent) if absent else logs
    own = stable_uuid(F.col("id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("source"), F.col("event_type"))
    return full.withColumn("uuid", F.coalesce(F.nullif("uuid", F.lit("")), own))


def _pick(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is not empty, as text."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def clean_records(records: DataFrame, now: Column, layout: str = ACCESS) -> DataFrame:
    """Loose records with defaults filled in, in the given layout.

    ``now`` is the job's time; it stands in for a missing timestamp.
    """
    kinds = dict(records.dtypes)
    if kinds.get("timestamp", "string").startswith("timestamp"):
        time = F.coalesce(iso_utc(F.col("timestamp")), iso_utc(now))
    else:
        time = normalize_time(F.coalesce(_pick(records, "timestamp", "Timestamp"), iso_utc(now)))
    status_name = next((n for n in ("status_code", "Status_Code", "status") if n in records.columns), None)
    if status_name and kinds[status_name] != "string":
        status = normalize_status(F.col(status_name), kinds[status_name])
    else:
        status = normalize_status(_pick(records, "status_code", "Status_Code", "status"))
    event = F.upper(strip(F.coalesce(_pick(records, "event_type", "Request_Type", "event"), F.lit("SYSTEM_EVENT"))))
    source = strip(F.coalesce(_pick(records, "source", "service", "User_Agent"), F.lit("api-service")))
    session = F.coalesce(_pick(records, "session_id", "Session_ID", "endpoint"), F.lit("1000"))
    session = F.replace(F.replace(session, F.lit("/session/"), F.lit("")), F.lit("/"), F.lit(""))
    given = F.col("id") if kinds.get("id") == "string" else F.lit(None).cast("string")
    own = stable_uuid(*[F.col(c) for c in sorted(records.columns) if not kinds[c].startswith(("array", "map", "struct"))])
    cleaned = records.select(
        F.when(F.length(given) >= 10, given).otherwise(own).alias("id"),
        time.alias("timestamp"),
        F.coalesce(normalize_ip(F.coalesce(_pick(records, "ip_address", "IP_Address", "ip"), F.lit("127.0.0.1"))), F.lit("127.0.0.1")).alias("ip_address"),
        event.alias("event_type"),
        status.alias("status_code"),
        source.alias("source"),
        capitalized(source).alias("user_agent"),
        F.coalesce(filled(session), F.lit("1000")).alias("session_id"),
        F.coalesce(filled(_pick(records, "location", "Location")), F.lit("Global")).alias("location"),
        _pick(records, "message", "Message").alias("_message"),
        _pick(records, "severity").alias("_severity"),
    )
    code = F.col("status_code")
    derived = F.when(code >= 500, "ERROR").when(code >= 400, "WARNING").otherwise("INFO")
    told = F.concat(F.lit("Event "), F.col("event_type"), F.lit(" on "), F.col("source"))
    whole = cleaned.withColumns({
        "message": strip(F.coalesce("_message", told)),
        "severity": F.upper(strip(F.coalesce("_severity", derived))),
    })
    texts = dict(whole.dtypes)
    return whole.select(*[(json_text(F.col(c)) if texts[c] == "string" else F.col(c)).alias(c) for c in LAYOUTS[layout]])


def clean_metrics(cleaned: DataFrame) -> DataFrame:
    """One row of counts; ``nulls_repaired`` is always 0."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("total_input"),
        F.count(F.lit(1)).alias("cleaned_count"),
        F.lit(0).alias("nulls_repaired"),
        F.count_if(F.coalesce("timestamp", F.lit("")) != "").alias("timestamps_normalized"),
        F.count("status_code").alias("status_codes_normalized"),
    )


def clean_in_place(logs: DataFrame) -> DataFrame:
    """Logs with status, event type and ip cleaned; a missing ip becomes 127.0.0.1.

    Run detection before this step: the filled-in ip would count as one address.
    """
    ip = F.coalesce(normalize_ip(F.col("ip_address")), F.lit("127.0.0.1"))
    event = F.upper(strip(F.coalesce(F.nullif("event_type", F.lit("")), F.lit("SYSTEM_EVENT"))))
    return logs.withColumns({
        "status_code": F.coalesce(normalize_status(F.col("status_code"), "int"), F.col("status_code")),
        "event_type": F.coalesce(F.nullif(json_text(event), F.lit("")), F.col("event_type")),
        "ip_address": F.coalesce(F.nullif(json_text(ip), F.lit("")), F.col("ip_address")),
    })


def _shown(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def records(logs: DataFrame) -> DataFrame:
    """The display form of a log."""
    has = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("ai_explanation", "ai_root_cause", "ai_next_step")]
    return stored(logs).select(
        "id", "uuid", _shown("timestamp"), "source", "event_type", "severity", "ip_address", "status_code", "message",
        "endpoint", "anomaly", F.bround("anomaly_score", 1).alias("anomaly_score"), "anomaly_reason", "ai_explanation",
        "ai_root_cause", "ai_next_step", "ai_model", _shown("ai_analyzed_at"),
        (has[0] | has[1] | has[2]).alias("has_ai_analysis"), _shown("created_at"),
    )


def cloud_logs(logs: DataFrame, now: Column) -> DataFrame:
    return stored(logs).select(
        F.col("uuid").alias("id"), iso(F.col("timestamp")).alias("timestamp"), "event_type", "severity", "source",
        "ip_address", "status_code", "message", "endpoint",
        iso(F.coalesce("created_at", now.cast("timestamp_ntz"))).alias("created_at"),
        iso(F.coalesce("updated_at", now.cast("timestamp_ntz"))).alias("updated_at"),
    )


def cloud_anomalies(logs: DataFrame, now: Column, narrow: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Anomaly records, with the log columns in ``keep``; ``narrow`` gives the four columns an older target has."""
    rows = stored(logs.filter(F.col("anomaly"))).select(
        F.col("uuid").alias("id"), F.col("uuid").alias("log_id"), F.lit(True).alias("is_anomaly"),
        F.lit("true").alias("is_anamoly"), F.bround("anomaly_score", 2).alias("anomaly_score"),
        F.coalesce(F.nullif("anomaly_reason", F.lit("")), F.lit("Deterministic anomaly detection flagged this log.")).alias("reason"),
        F.lit(schema.DETECTED_BY).alias("detected_by"), iso(now.cast("timestamp_ntz")).alias("created_at"),
        *keep,
    )
    return rows.select("id", "log_id", "is_anomaly", "is_anamoly", *keep) if narrow else rows


def cloud_explanations(logs: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explanation records of the given logs, with their columns in ``keep``; what is missing is filled from a template."""
    full = stored(logs)

    def known(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    place = F.coalesce(known("endpoint"), F.col("event_type"))
    return full.select(
        F.col("uuid").alias("id"), F.col("uuid").alias("anomaly_id"),
        strip(F.coalesce(
            known("ai_explanation"), known("anomaly_reason"),
            F.format_string("Suspicious %s event flagged with severity %s.", "event_type", "severity"),
        )).alias("explanation"),
        strip(F.coalesce(known("ai_root_cause"), F.format_string("Abnormal behavioral signature detected on %s.", place))).alias("root_cause"),
        strip(F.coalesce(known("ai_next_step"), F.lit("Review IP network logs and verify user authentication authorization."))).alias("next_step"),
        strip(F.coalesce(known("ai_model"), F.lit(schema.DEFAULT_MODEL))).alias("model"),
        iso(F.coalesce("ai_analyzed_at", now.cast("timestamp_ntz"))).alias("created_at"),
        *keep,
    )


def explained() -> Column:
    """Whether a log has an explanation or a cause."""
    return (F.coalesce(F.col("ai_explanation"), F.lit("")) != "") | (F.coalesce(F.col("ai_root_cause"), F.lit("")) != "")


# The columns of the export file.
EXPORT = {
    "ID": "id", "Timestamp": "timestamp", "Source": "source", "Event Type": "event_type", "Severity": "severity",
    "IP Address": "ip_address", "Status Code": "status_code", "Endpoint": "endpoint", "Message": "message",
    "Anomaly Score": "anomaly_score", "Anomaly Reason": "anomaly_reason", "AI Explanation": "ai_explanation",
    "AI Root Cause": "ai_root_cause", "AI Next Step": "ai_next_step",
}


def export_rows(logs: DataFrame) -> DataFrame:
    """Anomalies, newest first, as the text columns of the export file."""
    rows = stored(logs.filter(F.col("anomaly"))).orderBy(F.col("timestamp").desc(), F.col("id").desc())

    def text(name: str) -> Column:
        value = F.col(name)
        if name == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        if name == "status_code":
            value = F.when(value != 0, value)
        return F.coalesce(value.cast("string"), F.lit(""))

    return rows.select(*[text(name).alias(title) for title, name in EXPORT.items()])


def export_csv(logs: DataFrame, path: str) -> None:
    """Write the export as CSV parts in order, each with the header."""
    writer = export_rows(logs).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("nullValue", "").option("emptyValue", "").csv(path)

"""The event tables read as logs, raw log text and raw access-log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import prepare

_START = 1704067200  # 2024-01-01 UTC
_SQUEEZE = 50  # time runs 50 times faster, which makes bursts and ties


def events(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/events.parquet")


def logs_from_events(e: DataFrame) -> DataFrame:
    """Events as log rows: id, timestamp, source, ..., message."""
    k = F.regexp_extract("props", r"(\d+)", 1).try_cast("int")
    user, value, event_id = F.col("user_id"), F.col("value"), F.col("event_id")
    offset = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(_START * 1_000_000)
    seconds = F.lit(_START) + F.call_function("div", offset, F.lit(_SQUEEZE * 1_000_000))
    base = e.select(
        event_id.alias("id"),
        F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("timestamp"),
        F.when(user % 17 == 0, "web-bot").otherwise(F.concat(F.lit("svc-"), (user % 8).cast("string"))).alias("source"),
        F.when(event_id % 2500 == 7, "KERNEL_PANIC")
        .when(F.col("event_type") == "click", "PUT")
        .when(F.col("event_type") == "view", "GET")
        .when(F.col("event_type") == "purchase", "POST")
        .when(F.col("event_type") == "signup", "LOGIN")
        .when(k % 4 == 0, "DELETE")
        .otherwise("GET").alias("event_type"),
        F.when(k != 99, F.concat(F.lit("10.0.0."), (user % 60).cast("string"))).alias("ip_address"),
        F.when(
            F.col("event_type") == "error",
            F.element_at(F.array(*[F.lit(c) for c in (500, 503, 404, 401, 403, None)]), k % 6 + 1),
        ).when(F.col("event_type") == "signup", 201).otherwise(200).cast("int").alias("status_code"),
        F.when(event_id % 997 == 5, "North Korea")
        .when(event_id % 4000 == 11, "Iceland")
        .when(event_id % 10 == 0, F.lit(None))
        .otherwise(F.element_at(
            F.array(*[F.lit(c) for c in ("USA", "Germany", "India", "France", "Brazil", "Canada", "China")]),
            (F.when((user % 60).isin(3, 4), event_id).otherwise(user % 60) % 7 + 1).cast("int"),
        )).alias("location"),
        value.alias("value"),
    )
    status = F.col("status_code")
    endpoint = F.concat(F.lit("/api/v1/"), F.lower("event_type"))
    return base.select(
        "id", "timestamp", "source", "event_type",
        F.when(F.col("value") >= 200, "CRITICAL")
        .when(status >= 500, "ERROR")
        .when(status.isin(401, 403, 404), "WARNING")
        .otherwise("INFO").alias("severity"),
        "ip_address", "status_code",
        endpoint.alias("endpoint"),
        F.concat_ws(
            " | ",
            F.concat_ws(" ", "event_type", endpoint),
            F.concat(F.lit("HTTP "), status.cast("string")),
            F.concat(F.lit("Location: "), F.col("location")),
        ).alias("message"),
    )


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs_from_events(events(spark, folder))


def logs_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows as dirty text, one in fifty of them twice."""
    source = logs(spark, folder)
    repeats = F.when(F.col("id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = source.withColumn("r", F.explode(repeats))
    i, ts, status = F.col("id"), F.col("timestamp"), F.col("status_code")
    return rows.select(
        (i + 1 + F.col("r") * F.lit(10_000_000)).alias("row_no"),
        F.when(i % 109 == 0, "")
        .when(i % 113 == 0, "not-a-date")
        .when(i % 5 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(i % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(i % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(i % 5 == 3, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "dd-MM-yyyy HH:mm:ss")).alias("timestamp"),
        F.when(i % 127 == 0, "").otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("source"),
        F.when(i % 131 == 0, "").otherwise(F.lower("event_type")).alias("event_type"),
        F.when(i % 137 == 0, "BAD").when(i % 139 == 0, "")
        .when(i % 3 == 0, F.lower("severity")).otherwise(F.col("severity")).alias("severity"),
        "ip_address",
        F.when(i % 149 == 0, "999").when(i % 151 == 0, "abc").when(status.isNull(), "nan")
        .when(i % 4 == 1, F.concat(status.cast("string"), F.lit(".0")))
        .otherwise(status.cast("string")).alias("status_code"),
        F.when(i % 7 == 0, "").otherwise(F.col("endpoint")).alias("endpoint"),
        F.when(i % 11 == 0, "").otherwise(F.col("message")).alias("message"),
    )


def access_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same logs under an access-log header, as text."""
    i = F.col("id")
    return logs(spark, folder).select(
        (i + 1).alias("row_no"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("ip_address").alias("IP_Address"),
        F.col("event_type").alias("Request_Type"),
        F.col("status_code").cast("string").alias("Status_Code"),
        F.when(i % 23 == 0, "").when(F.col("source") == "web-bot", "Bot")
        .when(i % 2 == 0, "Firefox").otherwise("Internet Explorer").alias("User_Agent"),
        (F.lit(1000) + i % 4000).cast("string").alias("Session_ID"),
        F.regexp_extract("message", "Location: ([^|]+)", 1).alias("Location"),
    )

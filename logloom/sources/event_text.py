"""Event text dumps (``Event[n]`` blocks) as log records; batch or streaming."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import filled, strip, without_controls
from logloom.functions.times import iso_utc, normalize_time, parse_time
from logloom.sources import ranges
from logloom.sources.delimited import number_rows

# The block mark, and below the field names and levels of the dump.
_BLOCK = r"(?m)^\s*Event\[\d+\]"
#: What follows it to the end of the block is the message.
_DETAIL = "Description:"


def event_records(lines: DataFrame) -> DataFrame:
    """``text`` and ``row_no`` (ascending over files and places) of every block of event dumps.

    ``lines`` come from ``ranges.lines_of``. A dump may have any size: its splits are
    read by many tasks, and a block that lies across a border is put together.
    """
    begins = lambda part: pc.match_substring_regex(part, r"^[\t-\r ]*Event\[[0-9]+\]")
    found = ranges.whole_records(ranges.pieces(ranges.packed(lines), lambda _: begins))
    return number_rows(found).filter(strip(F.regexp_replace("text", _BLOCK, "")) != "")


def read_event_text(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all dumps at ``path``, in order: ``text`` and ``row_no``."""
    return event_records(ranges.lines_of(spark.read.text(path)))


def _field(block: Column, pattern: str) -> Column:
    return filled(F.regexp_extract(block, pattern, 1))


def parse_event_text(
    df: DataFrame, captured_at: Column, channel: str = "Application", ip: str = "127.0.0.1",
    source_chars: int | None = 50, message_chars: int | None = 300,
) -> DataFrame:
    """One record per block of the ``text`` column, other columns kept.

    ``captured_at`` stands in for a missing date; ``ip`` is the capturing host's.
    Sources and messages are cut to the given lengths, None leaves them whole.
    """
    blocks = df.withColumn("block", F.explode(F.split("text", _BLOCK))).filter(strip(F.col("block")) != "").drop("text")
    parts = blocks.withColumns({
        "date": _field(F.col("block"), r"Date:\s*(.+)"),
        "name": F.coalesce(_field(F.col("block"), r"Source:\s*(.+)"), F.lit(f"Windows-{channel}")),
        "level": F.coalesce(F.lower(_field(F.col("block"), r"Level:\s*(.+)")), F.lit("information")),
        "code": F.coalesce(F.regexp_replace(_field(F.col("block"), r"Event ID:\s*(\d+)"), r"^0+(?=\d)", ""), F.lit("100")),
        "detail": F.when(F.locate(_DETAIL, F.col("block")) > 0, F.substr("block", F.locate(_DETAIL, F.col("block")) + len(_DETAIL))),
    })
    clean = F.when(F.col("detail") != "", strip(F.regexp_replace(without_controls(strip(F.col("detail"))), r"(?U)\s+", " ")))
    text = F.coalesce(clean, F.lit("Windows Event Log Entry"))
    level = F.col("level")
    if message_chars is not None:
        text = F.when(F.length(text) > message_chars, F.concat(F.substring(text, 1, message_chars), F.lit("..."))).otherwise(text)
    return parts.withColumns({
        "timestamp": F.coalesce(normalize_time(F.col("date")), iso_utc(captured_at)),
        "source": F.col("name") if source_chars is None else F.substring("name", 1, source_chars),
        "event_type": F.lit(f"WIN_{channel.upper()}"),
        "severity": F.when(level.contains("crit"), "CRITICAL").when(level.contains("err"), "ERROR")
        .when(level.contains("warn"), "WARNING").otherwise("INFO"),
        "status_code": F.when(level.contains("crit"), 503).when(level.contains("err"), 500)
        .when(level.contains("warn"), 403).otherwise(200),
        "ip_address": F.lit(ip),
        "endpoint": F.concat(F.lit(f"/system/{channel.lower()}/"), "code"),
        "message": F.coalesce(
            F.nullif(text, F.lit("")),
            F.concat(F.lit(f"Windows {channel} Event "), "code", F.lit(" from "), "name"),
        ),
    }).drop("block", "date", "name", "level", "code", "detail")


def as_logs(events: DataFrame, captured_at: Column) -> DataFrame:
    """Event records with a typed timestamp, ready to be appended to the logs."""
    return events.withColumn("timestamp", F.coalesce(parse_time(F.col("timestamp")), captured_at.cast("timestamp_ntz")))

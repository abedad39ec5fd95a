"""Turn raw text rows into valid log records and a full error report.

All rules are one projection: nothing is shuffled until duplicates are marked.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.text import filled, first_filled
from logloom.functions.times import parse_time
from logloom.operators.skew import lookup
from logloom.session import staged

_NULL_WORDS = ("nan", "none", "null")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Error texts.
NO_TIME = "Missing required timestamp field."
BAD_TIME = "Invalid timestamp format: '%s'."
BAD_STATUS = "Invalid status code numeric value: '%s'."
STATUS_RANGE = "HTTP status code must be between 100 and 599. Got '%s'."
NO_EVENT = "Missing required event_type/request_type field."
NO_SOURCE = "Missing required field 'source'."
NO_SEVERITY = "Missing required field 'severity'."
BAD_SEVERITY = "Invalid severity '%s'. Must be one of: " + ", ".join(sorted(schema.SEVERITIES)) + "."
EMPTY_FILE = "Uploaded file is completely empty."
NO_HEADER = "CSV file has no header row or columns defined."
NO_ROWS = "Dataset is empty. No log records found."

ERROR_TYPE = "struct<field:string,message:string>"
#: The columns that a record is made from; others are not read.
COLUMNS = frozenset(name for names in schema.ALIASES.values() for name in names) | {"source", "severity", "user_agent", "location", "session_id"}
DUPLICATE_KEY = ("timestamp", "source", "event_type", "status_code", "ip_address")


def normalize_header(name: str) -> str:
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def normalize_names(df: DataFrame) -> DataFrame:
    """Normalised column names; of columns with one name the last counts.

    Columns starting with an underscore carry the row's origin and are kept.
    """
    last = {normalize_header(name): place for place, name in enumerate(df.columns) if name.strip()}
    positional = df.toDF(*[f"c{place}" for place in range(len(df.columns))])
    return positional.select(*[F.col(f"c{place}").alias(name) for name, place in last.items()])


def _error(condition: Column, field: str, text: str, value: Column | None = None) -> Column:
    message = F.lit(text) if value is None else F.format_string(text, value)
    return F.when(condition, F.struct(F.lit(field).alias("field"), message.alias("message")))


def _severity_from_status(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status.isin(401, 403, 404), "WARNING").otherwise("INFO")


def _source(df: DataFrame) -> Column:
    """The source column when there is one, otherwise a name built from what is known."""
    if "source" in df.columns:
        return filled(F.col("source"))
    agent = F.lower(first_filled(df, ("user_agent",)))
    location = F.lower(first_filled(df, ("location",)))
    return F.coalesce(
        first_filled(df, schema.ALIASES["derived_source"]),
        F.when(agent.isNotNull() & location.isNotNull(), F.concat(F.lit("web-"), F.replace(agent, F.lit(" "), F.lit("-")))),
        F.concat(F.lit("web-"), agent),
        F.concat(F.lit("web-"), location),
        F.lit("web-server-01"),
    )


def check_rows(raw: DataFrame) -> DataFrame:
    """``raw`` plus the record's fields under ``v`` and its errors under ``errors``.

    ``raw`` has text columns with normalised names and a unique ``row_no``.
    A stopping error hides all later ones; status errors do not stop.
    """
    picked = raw.select(
        "row_no",
        first_filled(raw, schema.ALIASES["timestamp"]).alias("time_text"),
        first_filled(raw, schema.ALIASES["status_code"]).alias("status_text"),
        F.upper(first_filled(raw, schema.ALIASES["event_type"])).alias("event_type"),
        _source(raw).alias("source"),
        first_filled(raw, ("severity",) if "severity" in raw.columns else schema.ALIASES["derived_severity"]).alias("severity_text"),
        first_filled(raw, schema.ALIASES["ip_address"]).alias("ip_address"),
        first_filled(raw, schema.ALIASES["endpoint"]).alias("endpoint_text"),
        first_filled(raw, schema.ALIASES["message"]).alias("message_text"),
        first_filled(raw, ("user_agent",)).alias("agent"),
        first_filled(raw, ("location",)).alias("location"),
        first_filled(raw, ("session_id",)).alias("session"),
    )
    plain = F.regexp_replace("status_text", r"(?<=\d)_(?=\d)", "")
    given = F.col("status_text").isNotNull() & ~F.lower("status_text").isin(*_NULL_WORDS)
    number = F.when(given & plain.rlike(_NUMBER), plain.try_cast("double"))
    in_range = (number >= 100) & (number < 600)
    status = F.when(in_range, number.cast("int"))
    parsed = picked.withColumns({
        "ts": parse_time(F.col("time_text")),
        "status_given": given,
        "status_number": number,
        "status_code": status,
        "severity": F.upper("severity_text"),
    })

    # The first stopping error, if any; status errors come before event errors.
    time_error = F.coalesce(
        _error(F.col("time_text").isNull(), "timestamp", NO_TIME),
        _error(F.col("ts").isNull(), "timestamp", BAD_TIME, F.col("time_text")),
    )
    status_error = F.coalesce(
        _error(F.col("status_given") & F.col("status_number").isNull(), "status_code", BAD_STATUS, F.col("status_text")),
        _error(F.col("status_given") & F.col("status_code").isNull(), "status_code", STATUS_RANGE, F.col("status_text")),
    )
    severity_missing = (
        [_error(F.col("severity_text").isNull(), "severity", NO_SEVERITY)] if "severity" in raw.columns else []
    )
    later_error = F.coalesce(
        _error(F.col("event_type").isNull(), "event_type", NO_EVENT),
        _error(F.col("source").isNull(), "source", NO_SOURCE),
        *severity_missing,
        _error(~F.col("severity").isin(*schema.SEVERITIES), "severity", BAD_SEVERITY, F.col("severity_text")),
    )
    errors = F.when(time_error.isNotNull(), F.array(time_error)).otherwise(
        F.array_compact(F.array(status_error, later_error))
    )

    endpoint = F.coalesce(
        F.col("endpoint_text"),
        F.concat(F.lit("/session/"), F.col("session")),
        F.concat(F.lit("/api/v1/"), F.lower("event_type")),
    )
    message = F.coalesce(
        F.col("message_text"),
        F.concat_ws(
            " | ",
            F.concat_ws(" ", "event_type", "endpoint"),
            F.concat(F.lit("HTTP "), F.col("status_code").cast("string")),
            F.concat(F.lit("Agent: "), F.col("agent")),
            F.concat(F.lit("Location: "), F.col("location")),
            F.concat(F.lit("Session: "), F.col("session")),
        ),
    )
    return (
        parsed.withColumns({"errors": errors, "endpoint": endpoint})
        .select(
            "row_no",
            F.col("ts").alias("timestamp"),
            "source",
            "event_type",
            F.coalesce("severity", _severity_from_status(F.col("status_code"))).alias("severity"),
            "ip_address",
            "status_code",
            "endpoint",
            message.alias("message"),
            "errors",
        )
    )


def mark_duplicates(valid: DataFrame) -> DataFrame:
    """Flag every valid row that is not the first of its key.

    Keys are counted with partial aggregation, and only those that occur more
    than once are looked up; rows are not moved for the others, and no key is
    gathered in one task. Null and empty parts of a key differ.
    """
    parts = [part for c in DUPLICATE_KEY for part in (F.col(c), F.col(c).isNull())]
    key = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    keyed = valid.withColumn("_key", key)
    repeated = staged(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("_first")).filter("n > 1"))
    size, total = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = lookup(keyed, repeated, "_key", "row_no", size, total)
    flag = F.coalesce(F.col("row_no") != F.col("_first"), F.lit(False))
    return found.withColumn("is_duplicate", flag).drop("_key", "_first")


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def error_rows(checked: DataFrame) -> DataFrame:
    """One row per error: row number, field, message."""
    return checked.select("row_no", F.explode("errors").alias("e")).select(
        "row_no", F.col("e.field").alias("field"), F.col("e.message").alias("message")
    )


def summary(checked: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """One row: totals, valid, rejected, errors, duplicates.

    Duplicates are valid rows minus distinct keys, so no row is moved for them.
    """
    ok = F.size("errors") == 0
    counts = (
        checked.groupBy(*[F.when(ok, F.col(c)).alias(c) for c in DUPLICATE_KEY], ok.alias("ok"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("errors")).alias("e"))
    )
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_processed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("rejected_count"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n") - 1)), F.lit(0)).alias("duplicate_count"),
    ).withColumn("is_valid", F.col("valid_count") > 0)


def error_head(errors: DataFrame, limit: int = 20) -> DataFrame:
    """The first errors of the report, row number as text or ``N/A``."""
    # a row's status error precedes its stopping error, as in reverse name order
    ordered = errors.orderBy(F.col("row_no").asc_nulls_first(), F.col("field").desc())
    return ordered.limit(limit).select(
        F.coalesce(F.col("row_no").cast("string"), F.lit("N/A")).alias("row"), "field", "message"
    )


class Report:
    """Valid records, errors and the one-row summary of one batch, each made when it is first asked for.

    A first part is read straight from the text rows. Once a second is asked for,
    or the records with their duplicates, which need two passes, the checked rows
    are staged, as reading them again is cheaper than parsing the text again.
    """

    def __init__(self, checked: DataFrame):
        self._checked, self._asked, self._stored = checked, False, False

    def _rows(self, passes: int) -> DataFrame:
        if not self._stored and (self._asked or passes > 1):
            self._checked, self._stored = staged(self._checked), True
        self._asked = True
        return self._checked

    @cached_property
    def valid(self) -> DataFrame:
        return mark_duplicates(valid_rows(self._rows(2)))

    @cached_property
    def errors(self) -> DataFrame:
        return error_rows(self._rows(1))

    @cached_property
    def summary(self) -> DataFrame:
        return summary(self._rows(1))


class FileReport(Report):
    """The report of a file that could not be read as rows."""

    def __init__(self, valid: DataFrame, errors: DataFrame, totals: DataFrame):
        self.valid, self.errors, self.summary = valid, errors, totals


def validate(raw: DataFrame) -> Report:
    """Validate a batch of text rows that carries a unique ``row_no``."""
    return Report(check_rows(normalize_names(raw)))


def file_error(spark, field: str, message: str) -> Report:
    """The report of a file that could not be read as rows."""
    valid = spark.createDataFrame([], schema.LOG_VALID)
    errors = spark.createDataFrame([(None, field, message)], "row_no long, field string, message string")
    totals = spark.createDataFrame(
        [(0, 0, 0, 1, 0, False)],
        "total_processed long, valid_count long, rejected_count long, error_count long, duplicate_count long, is_valid boolean",
    )
    return FileReport(valid, errors, totals)

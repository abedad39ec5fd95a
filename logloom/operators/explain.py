"""Text for an explainer, its reply read safely, and the result attached to the log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.text import filled, iso, strip

# The field lines of the prompt and the keys of the reply.
INTRODUCTION = (
    "You help an operations and security team to understand one log entry.\n"
    "The entry was flagged by a rule-based detector; take that as given.\n"
    "Do NOT evaluate whether this log is anomalous."
)
REQUEST = (
    "Say why the entry matters for a system in production, what most likely caused it,\n"
    "and which concrete step should be taken next.\n"
    "Answer only with JSON of this form:\n"
    '{\n  "explanation": "...",\n  "likely_root_cause": "...",\n  "recommended_next_step": "..."\n}\n'
)
NO_CONTEXT = "No surrounding context available."
#: Prompts that a model is given at once.
BATCH = 256


def _or_na(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("N/A"))


def _or_none(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def build_prompt(df: DataFrame, introduction: str = INTRODUCTION, request: str = REQUEST) -> Column:
    """Prompt text of a log with its ``context`` array, if ``df`` has one."""
    time = F.replace(iso(F.col("timestamp")), F.lit("T"), F.lit(" "))
    status = F.when(F.col("status_code") != 0, F.col("status_code"))
    lines = [
        F.concat(F.lit("- Timestamp: "), _or_none(time)),
        F.concat(F.lit("- Source Service: "), _or_none(F.col("source"))),
        F.concat(F.lit("- Event Type: "), _or_none(F.col("event_type"))),
        F.concat(F.lit("- Severity: "), _or_none(F.col("severity"))),
        F.concat(F.lit("- IP Address: "), _or_na(F.col("ip_address"))),
        F.concat(F.lit("- HTTP Status Code: "), _or_na(status)),
        F.concat(F.lit("- Endpoint: "), _or_na(F.col("endpoint"))),
        F.concat(F.lit("- Log Message: "), _or_none(F.col("message"))),
        F.concat(F.lit("- Calculated Anomaly Score: "), F.format_string("%.1f", "anomaly_score"), F.lit("/100")),
        F.concat(F.lit("- Programmatic Detection Reason: "), _or_none(F.col("anomaly_reason"))),
    ]
    if "context" in df.columns:
        items = F.transform("context", lambda c: F.concat(
            F.lit("- ["), c.relative_position,
            F.lit("] Time: "), _or_none(F.date_format(c.timestamp, "yyyy-MM-dd HH:mm:ss")),
            F.lit(" | Source: "), _or_none(c.source),
            F.lit(" | Severity: "), _or_none(c.severity),
            F.lit(" | Status: "), _or_none(c.status_code),
            F.lit(" | Message: "), _or_none(c.message),
        ))
        context = F.when(F.size("context") > 1, F.array_join(items, "\n"))
    else:
        context = F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.lit(introduction), F.lit(""), F.lit("Target Anomaly Log Data:"), *lines, F.lit(""),
        F.lit("Surrounding Event Timeline Context:"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit(""),
        F.lit("Instructions:"), F.lit(request),
    )


def prompts(scored: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """``id`` and ``prompt`` of the anomalies; only these are ever explained."""
    rows = scored.filter(F.col("anomaly"))
    if context is not None:
        rows = rows.join(context, "id", "left")
    return rows.select("id", build_prompt(rows).alias("prompt"))


# Names, fallback texts and layouts of a reply's three parts.
# Unrolled, for Java's matcher recurses on alternatives and would overflow on long text.
_STRING = r'"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"'
_LINE = r"\s*:\s*([^\n\r]+)"
_PARTS = {
    "explanation": {
        "names": ("explanation",),
        "empty": "Anomalous event pattern detected requiring investigation.",
        "absent": "Anomalous event pattern detected.",
        "unread": "Anomalous event pattern detected requiring review.",
        "patterns": ('"explanation' + _STRING, "explanation" + _LINE),
    },
    "likely_root_cause": {
        "names": ("likely_root_cause", "root_cause"),
        "empty": "System anomaly or threshold deviation.",
        "absent": "System error or threshold deviation.",
        "unread": "High-severity HTTP status or unusual request frequency.",
        "patterns": (
            '"likely_root_cause' + _STRING, '"root_cause' + _STRING, "likely_root_cause" + _LINE, r"Root Cause:\s*([^\n\r]+)",
        ),
    },
    "recommended_next_step": {
        "names": ("recommended_next_step", "next_step"),
        "empty": "Check application error logs and verify service dependencies.",
        "absent": "Inspect surrounding logs and verify service status.",
        "unread": "Inspect service logs, verify downstream APIs, and monitor traffic patterns.",
        "patterns": (
            '"recommended_next_step' + _STRING, '"next_step' + _STRING, "recommended_next_step" + _LINE, r"Next Step:\s*([^\n\r]+)",
        ),
    },
}


def _object(text: Column) -> Column:
    """The text as a JSON object, null when it is anything else."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def _member(parsed: Column, name: str) -> Column:
    """A member as text; null, empty text, zero and false count as missing."""
    value = F.try_variant_get(parsed, f"$.{name}", "variant")
    text, kind = F.try_variant_get(parsed, f"$.{name}", "string"), F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(text == "true", "True"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.when(~text.isin("[]", "{}"), text))
        .otherwise(F.when(text.try_cast("double") != 0, text))
    )


def _found(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern whose value is longer than two characters."""
    values = []
    for pattern in patterns:
        value = strip(F.regexp_extract(text, "(?is)" + pattern, 1))
        value = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
        value = F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
        values.append(F.when(F.length(value) > 2, value))
    return F.coalesce(*values)


def parse_reply(replies: DataFrame, text: str = "reply", fallback_chars: int | None = 300) -> DataFrame:
    """``replies`` plus the three parts, never null.

    A reply is read as JSON, as JSON inside other text, as JSON with trailing
    commas, and failing that part by part. A reply without any part is itself the
    explanation, cut to ``fallback_chars`` (None: whole).
    """
    bare = F.regexp_replace(F.regexp_replace(filled(F.col(text)), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    staged_rows = replies.withColumn("_clean", strip(bare)).withColumn("_inner", F.regexp_extract("_clean", r"(?s)\{.*\}", 0))
    parsed = staged_rows.withColumn("_json", F.coalesce(
        _object(F.col("_clean")),
        _object(F.col("_inner")),
        _object(F.regexp_replace("_inner", r",\s*([}\]])", "$1")),
    ))
    whole = F.when(F.length("_clean") > 20, F.substring("_clean", 1, fallback_chars) if fallback_chars else F.col("_clean"))
    columns = {}
    for part, fixed in _PARTS.items():
        members = F.coalesce(*[_member(F.col("_json"), name) for name in fixed["names"]], F.lit(fixed["absent"]))
        fallback = [whole] if part == "explanation" else []
        loose = F.coalesce(_found(F.col("_clean"), fixed["patterns"]), *fallback, F.lit(fixed["unread"]))
        columns[part] = (
            F.when(F.col("_clean").isNull(), fixed["empty"]).when(F.col("_json").isNotNull(), members).otherwise(loose)
        )
    return parsed.withColumns(columns).drop("_clean", "_inner", "_json")


def explain(requests: DataFrame, model: Callable[[pd.DataFrame], pd.Series], name: str) -> DataFrame:
    """Call ``model`` on batches of ``(id, prompt)``; gives ``id, reply, ai_model``.

    The model is the user's function, e.g. a client of a hosted model. It runs
    on the executors and is given at most ``BATCH`` rows at a time, so that a
    worker holds the texts of so few, whatever Spark's batches are.
    """
    kind = pa.schema([("id", pa.int64()), ("reply", pa.string()), ("ai_model", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH):
                part = batch.slice(begin, BATCH).to_pandas()
                made = pd.DataFrame({"id": part["id"], "reply": model(part), "ai_model": name})
                yield pa.RecordBatch.from_pandas(made, schema=kind, preserve_index=False)

    return requests.select(F.col("id").cast("long").alias("id"), "prompt").mapInArrow(run, "id long, reply string, ai_model string")


def attach(logs: DataFrame, replies: DataFrame, analyzed_at: Column) -> DataFrame:
    """Logs with the parsed reply of those that have one; others keep what they had."""
    parsed = parse_reply(replies).select("id", "ai_model", *_PARTS)

    def part(name: str) -> Column:
        return F.coalesce(filled(F.col(name)), F.lit(_PARTS[name]["absent"]))

    new = parsed.select(
        "id",
        part("explanation").alias("_ai_explanation"),
        part("likely_root_cause").alias("_ai_root_cause"),
        part("recommended_next_step").alias("_ai_next_step"),
        F.coalesce("ai_model", F.lit(schema.DEFAULT_MODEL)).alias("_ai_model"),
        analyzed_at.cast("timestamp_ntz").alias("_ai_analyzed_at"),
    )
    names = ("ai_explanation", "ai_root_cause", "ai_next_step", "ai_model", "ai_analyzed_at")
    joined = logs.join(new, "id", "left")
    allowed = F.col("anomaly")
    kept = {
        n: F.coalesce(F.when(allowed, F.col(f"_{n}")), F.col(n) if n in logs.columns else F.lit(None).cast(schema.STORED_EXTRAS[n]))
        for n in names
    }
    return joined.withColumns(kept).drop(*[f"_{n}" for n in names])

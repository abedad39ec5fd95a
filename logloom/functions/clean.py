"""Scalar cleaning: status codes, ips and values fit for JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import filled, iso, null_words, strip, without_controls

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize_status(value: Column, kind: str = "string") -> Column:
    """A status code between 100 and 599 found in the value, else null.

    Text gives its first stand-alone three-digit code; numbers are cut to whole.
    """
    if kind != "string":
        number = value.cast("double")
        return F.when((number >= 100) & (number < 600), number.cast("int"))
    text = null_words(filled(value), ("nan", "none", "null", "-", "n/a"))
    code = F.regexp_extract(text, r"\b([1-5]\d\d)\b", 1).try_cast("int")
    number = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    return F.coalesce(code, F.when((number >= 100) & (number < 600), number.cast("int")))


def normalize_ip(value: Column) -> Column:
    return null_words(filled(value), ("nan", "none", "null", "n/a", "-"))


def json_text(value: Column) -> Column:
    """Text without control characters (tab and line ends stay) and outer blanks."""
    return strip(without_controls(value))


def json_value(value: Column, kind: T.DataType) -> Column:
    """The value in a form JSON can hold, walked along its type."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
        return F.when(~bad, F.bround(number, 6))
    if isinstance(kind, T.StringType):
        return json_text(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(value)
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: json_value(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            e["key"].cast("string").alias("key"), json_value(e["value"], kind.valueType).alias("value")
        ))
        return F.map_from_entries(entries)
    if isinstance(kind, T.StructType):
        fields = [json_value(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitize(df: DataFrame) -> DataFrame:
    """Every column in a form JSON can hold."""
    return df.select(*[json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row, absent values written as null."""
    clean = sanitize(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]), {"ignoreNullFields": "false"}).alias(name))

"""Whole-table counts the signals compare a log with, from one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.text import filled, strip
from logloom.session import staged

MIN_HOPS = 3
MIN_404 = 3


def location_of(message: Column, source: Column) -> Column:
    """Location named in the message, else the one in a ``web-`` source; null when neither."""
    told = filled(F.regexp_extract(message, r"(?i)Location:\s*([^|]+)", 1))
    rest = strip(F.replace(source, F.lit("web-"), F.lit("")))
    from_source = F.when(source.startswith("web-") & F.lower(rest).isin(*schema.SOURCE_LOCATIONS), rest)
    return F.coalesce(told, from_source)


def with_location(logs: DataFrame) -> DataFrame:
    return logs.withColumn("location", location_of(F.col("message"), F.col("source")))


def profile(logs: DataFrame) -> DataFrame:
    """Rows ``(kind, key, n, n_404, n_locations)`` for events, sources, locations and ips.

    Each log feeds four keys of one partially aggregated count. Counting by
    location first and by key second keeps distinct counting partial too, so a
    frequent key reaches the shuffle as one row per task and location.
    """
    def entry(kind: str, key: Column, place: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), place.cast("string").alias("place"))

    kinds = F.array(
        entry("event", F.nullif("event_type", F.lit(""))),
        entry("source", F.nullif("source", F.lit(""))),
        entry("location", F.col("location")),
        entry("ip", F.nullif("ip_address", F.lit("")), F.col("location")),
        entry("all", F.lit("all")),
    )
    is_404 = F.coalesce((F.col("status_code") == 404).cast("long"), F.lit(0))
    return (
        with_location(logs)
        .select(F.inline(kinds), is_404.alias("is_404"))
        .filter(F.col("key").isNotNull())
        .groupBy("kind", "key", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("is_404").alias("n_404"))
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.sum("n_404").alias("n_404"), F.count("place").alias("n_locations"))
    )


def counts_of(profiled: DataFrame, kind: str, name: str) -> DataFrame:
    return profiled.filter(F.col("kind") == kind).select(F.col("key").alias(name), "n")


def ip_profile(profiled: DataFrame) -> DataFrame:
    return profiled.filter(F.col("kind") == "ip").select(F.col("key").alias("ip_address"), "n", "n_404", "n_locations")


def notable_ips(profiled: DataFrame) -> DataFrame:
    """Only the ips that can trigger a signal."""
    return ip_profile(profiled).filter((F.col("n_locations") >= MIN_HOPS) | (F.col("n_404") >= MIN_404))


@dataclass(frozen=True)
class Profile:
    """A staged profile with the sizes and the short lists that decide the scoring plan.

    A location or event type is common when it holds more than half a percent or
    one percent of the logs, so there are at most 200 and 100 of them. All
    others are rare, however many there are.
    """

    table: DataFrame
    total: int
    sizes: dict[str, int]
    common_locations: tuple[str, ...]
    common_events: tuple[str, ...]


def rare_limit(total: int, share: float) -> int:
    return max(1, int(total * share))


def take_profile(logs: DataFrame) -> Profile:
    return load_profile(staged(profile(logs)))


def load_profile(table: DataFrame) -> Profile:
    """Read the sizes of a stored profile: five counts and two short lists."""
    notable = (F.col("kind") != "ip") | (F.col("n_locations") >= MIN_HOPS) | (F.col("n_404") >= MIN_404)
    found = {
        row["kind"]: row
        for row in table.groupBy("kind").agg(F.count_if(notable).alias("size"), F.sum("n").alias("n")).collect()
    }
    total = found["all"]["n"] if "all" in found else 0
    limits = {
        "location": rare_limit(total, schema.RARE_LOCATION_SHARE),
        "event": rare_limit(total, schema.RARE_EVENT_SHARE),
    }
    common = table.filter(
        ((F.col("kind") == "location") & (F.col("n") > limits["location"]))
        | ((F.col("kind") == "event") & (F.col("n") > limits["event"]))
    ).select("kind", "key").collect()
    return Profile(
        table,
        total,
        {kind: row["size"] for kind, row in found.items()},
        tuple(sorted(row["key"] for row in common if row["kind"] == "location")),
        tuple(sorted(row["key"] for row in common if row["kind"] == "event")),
    )

"""Joining rows to a table with one row per key, whatever the key frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_SIDES = 4096


def lookup(rows: DataFrame, table: DataFrame, key: str, row_id: str, size: int, total: int) -> DataFrame:
    """Left join ``table`` (``key``, ``n`` rows per key, numbers) to ``rows``.

    Keys are joined by 128 bits of hash, so that a row of the table has a fixed
    size whatever its text, and a bound in rows is one in bytes (some 10 MB). A
    table of at most BROADCAST_ROWS rows is broadcast. A larger one is split:
    at most BROADCAST_ROWS keys can each hold more than that fraction of the
    rows, so these are broadcast, and all others are shuffled with no key above
    that fraction. Rows without a shuffle partner are spread by ``row_id``.
    """
    values = [c for c in table.columns if c not in (key, "n")]
    hashed = F.when(F.col(key).isNotNull(), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))
    rows_ = rows.withColumn("_hash", hashed)
    table = table.select(hashed.alias("_hash"), "n", *values)
    if size <= BROADCAST_ROWS:
        return rows_.join(F.broadcast(table.drop("n")), "_hash", "left").select(*rows.columns, *values)
    share = total / BROADCAST_ROWS
    frequent = table.filter(F.col("n") > share).select(
        "_hash", F.lit(True).alias("_frequent"), F.struct(*values).alias("_near")
    )
    others = table.filter(F.col("n") <= share).select("_hash", F.lit(0).alias("_side"), F.struct(*values).alias("_far"))
    placed = rows_.join(F.broadcast(frequent), "_hash", "left").withColumn(
        "_side",
        F.when(F.col("_frequent") | F.col("_hash").isNull(), F.lit(1) + F.pmod(F.xxhash64(row_id), F.lit(_SIDES)))
        .otherwise(0).cast("int"),
    )
    joined = placed.join(others, ["_hash", "_side"], "left").withColumn("_got", F.coalesce("_near", "_far"))
    return joined.select(*rows.columns, *[F.col(f"_got.{v}").alias(v) for v in values])

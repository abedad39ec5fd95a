"""Helpers shared by the operators: words, exact running totals, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import ship, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words that consist of digits, ASCII letters and all characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters other than A-Z that full lower-casing could change.
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
#: Most rows that a broadcast side may have (two or three numbers each: at most some tens of MB).
BROADCAST_ROWS = 1_000_000

#: Most rows of a sieve, 4 KB or 2^15 bits each: 16 MB.
SIEVE = 4096

#: Keys that may be heavy: their entries are broadcast, all of one vector, text key or count.
HEAVY = 1000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Full lower-casing is faster and serves where it does the same."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a lower-cased text between ASCII signs; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS, -1), "")


def text_key(text: Column) -> Column:
    """Tells rows of equal id but other text apart; null differs from empty."""
    return F.coalesce(F.xxhash64(text, F.length(text)), F.lit(0))


def text_id(text: Column) -> Column:
    """128 bits that tell texts apart; null has none of them and differs from empty."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def small(table: DataFrame) -> DataFrame:
    """Broadcast ``table`` if its counted rows are few, else shuffle it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


def meet(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with a table that has each ``key`` once.

    ``counts`` (``key``, ``_n``) may tell what is known of the rows per key.
    A key of more than 1/HEAVY of the rows is heavy; there are at most HEAVY such
    keys, and their entries are broadcast, so that no task gets all their rows.
    The others are shuffled.
    """
    if counts is None:
        counts = staged(rows.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often = F.broadcast(counts.filter(F.col("_n") * HEAVY > total).select(key))
    some = rows.join(F.broadcast(table.join(often, key, "left_semi")), key)
    rest = rows.join(often, key, "left_anti").join(table.join(often, key, "left_anti"), key)
    return some.unionByName(rest)


def sifted(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``, false only where ``key`` is not in ``table``; rows stay where they are.

    The hashed keys of ``table`` are set as bits, some sixteen for each and 2^27 at
    most, and broadcast. More keys make ``_maybe`` true more often, never wrongly
    false, so an exact join of what is left must follow. ``table`` is read twice.
    """
    parts = min(SIEVE, table.count() // 2048 + 1)
    place = F.pmod(F.xxhash64(key), F.lit(parts << 15))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    bits = table.select(bucket.alias("_bucket"), bit.cast("long").alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket", "left").withColumn("_maybe", maybe).drop("_bucket", "_bits")


def workers(spark: SparkSession) -> None:
    """Ship this package to the executors and keep Arrow batches small, for texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the exact sum of ``value`` over all rows before, by ``order``.

    Rows are sorted over ranges; each range is summed by itself and starts at the
    total of those before it. Only one number per range comes to the driver.
    Rows equal in ``order`` may stand in either order.
    """
    spark = rows.sparkSession
    ranges = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    begin, starts = 0, []
    for number, amount in sorted((r[0], r[1] or 0) for r in ranges.groupBy("_range").agg(F.sum(value)).collect()):
        starts.append((number, begin))
        begin += amount
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    before = spark.createDataFrame(starts, "_range int, _begin long")
    within = "sum(`{}`) over (partition by _range order by {} rows between unbounded preceding and 1 preceding)".format(
        value, ", ".join(f"`{c}` asc nulls first" for c in order))
    return (
        ranges.join(F.broadcast(before), "_range")
        .withColumn(name, F.coalesce(F.expr(within), F.lit(0)) + F.col("_begin"))
        .drop("_range", "_begin")
    )

"""The logs around a log: up to three before and three after with its source or its ip.

Before means at or before its time, after means at or after it, so a log with
the same time may appear on both sides. Logs without an ip count as sharing it.
Ties: the largest id is the nearest before, the smallest the nearest after.

For one log (:func:`around`) two filtered top-3 scans do. For many logs
(:func:`neighbours`) each source and ip is laid out in time without ever
sorting one of them in a single task:

* of the logs with one key and one time only the first and last few ids
  matter; they are picked per block of 2**20 ids first and then per time;
* the times of a key are looked at per second, the edges of the seconds per
  hour, and the edges of the hours per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import micros
from logloom.operators.skew import BROADCAST_ROWS
from logloom.operators.trailing import BLOCK_BITS
from logloom.session import staged

REACH = 3
# Nested stretches of time in microseconds: a second, then 3,600 of them.
_SECOND, _HOUR = 1_000_000, 3_600
_KEY = ["_kind", "_key"]
SHOWN = ("timestamp", "source", "severity", "status_code", "message")


def _keyed(logs: DataFrame) -> DataFrame:
    """Each log once under its source and once under its ip."""
    keys = F.array(
        F.struct(F.lit("source").alias("_kind"), F.coalesce("source", F.lit("")).alias("_key")),
        F.struct(
            F.when(F.col("ip_address").isNull(), "no ip").otherwise("ip").alias("_kind"),
            F.coalesce("ip_address", F.lit("")).alias("_key"),
        ),
    )
    return logs.select(
        F.col("id").cast("long").alias("id"),
        micros(F.col("timestamp")).alias("_t"),
        F.shiftright(F.col("id").cast("long"), BLOCK_BITS).alias("_block"),
        F.inline(keys),
    )


def _edges(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The ``count`` smallest and largest ids per group, with their ranks."""
    group = Window.partitionBy(*keys)
    ranked = rows.withColumn("_up", F.row_number().over(group.orderBy("id"))).withColumn(
        "_down", F.count(F.lit(1)).over(group) - F.col("_up") + 1
    )
    return ranked.filter((F.col("_up") <= count) | (F.col("_down") <= count))


def _times(keyed: DataFrame, reach: int) -> DataFrame:
    """One row per key and time: ``last`` (nearest first, largest id) and ``first`` (smallest id)."""
    few = reach + 1
    per_block = _edges(keyed, [*_KEY, "_t", "_block"], few).select(*_KEY, "_t", "id")
    edges = _edges(per_block, [*_KEY, "_t"], few)
    ref = F.struct(F.col("_t").alias("t"), F.col("id").alias("id"))
    return edges.groupBy(*_KEY, "_t").agg(
        F.sort_array(F.collect_list(F.when(F.col("_down") <= few, ref)), asc=False).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("_up") <= few, ref))).alias("first"),
    )


def _joined(reach: int, *arrays: Column) -> Column:
    return F.slice(F.flatten(F.array_compact(F.array(*arrays))), 1, reach)


def _context(groups: DataFrame, at: str, reach: int, widths: tuple[int, ...]) -> DataFrame:
    """``groups`` plus ``before`` and ``after``: the nearest logs of the key's other times.

    Every row stands for at least one log, so ``reach`` rows on either side are
    enough. Inside a stretch they are neighbouring rows; what lies beyond its
    edge comes from the same step on one summary row per stretch. Only the rows
    marked ``_wanted``, where there is such a column, are returned.
    """
    keys = [*_KEY, f"_{len(widths)}"] if widths else _KEY
    if widths:
        stretch = F.call_function("div", F.col(at) - F.pmod(F.col(at), F.lit(widths[0])), F.lit(widths[0]))
        groups = groups.withColumn(keys[-1], stretch)
    order = Window.partitionBy(*keys).orderBy(at)
    placed = groups.withColumns({
        "before": _joined(reach, *[F.lag("last", i).over(order) for i in range(1, reach + 1)]),
        "after": _joined(reach, *[F.lead("first", i).over(order) for i in range(1, reach + 1)]),
    })
    if not widths:
        return placed
    edges = placed.groupBy(*keys).agg(
        F.max_by(_joined(reach, F.col("last"), F.col("before")), at).alias("last"),
        F.min_by(_joined(reach, F.col("first"), F.col("after")), at).alias("first"),
    )
    beyond = _context(edges, keys[-1], reach, widths[1:]).select(
        *keys, F.col("before").alias("_before"), F.col("after").alias("_after")
    )
    if "_wanted" in placed.columns:
        placed = placed.filter("_wanted")
    return placed.join(beyond, keys).select(
        *_KEY, at, "last", "first",
        _joined(reach, F.col("before"), F.col("_before")).alias("before"),
        _joined(reach, F.col("after"), F.col("_after")).alias("after"),
    )


def _reachable(keyed: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """The logs of ``keyed`` in hours that may hold a neighbour of a wanted one.

    An hour that has logs has at least one, so those of the ``reach`` hours with
    logs before and after a wanted one are enough. Hours are counted with partial
    aggregation; all other logs stay out of the sorting.
    """
    stretch = _SECOND * _HOUR
    hour = F.call_function("div", F.col("_t") - F.pmod(F.col("_t"), F.lit(stretch)), F.lit(stretch)).alias("_hour")
    marked = keyed.select(*_KEY, hour, F.lit(0).alias("_wanted")).unionByName(wanted.select(*_KEY, hour, F.lit(1).alias("_wanted")))
    hours = marked.groupBy(*_KEY, "_hour").agg(F.max("_wanted").alias("_wanted"))
    near = F.max("_wanted").over(Window.partitionBy(*_KEY).orderBy("_hour").rowsBetween(-reach, reach))
    hashed = F.struct(F.xxhash64(*_KEY).alias("a"), F.xxhash64(F.lit(1), *_KEY).alias("b")).alias("_hash")
    needed = staged(hours.withColumn("_near", near).filter("_near = 1").select(hashed, "_hour"))
    few = needed.count() <= BROADCAST_ROWS  # a bound in bytes, too, as keys are hashes: the logs stay where they are
    return keyed.withColumns({"_hour": hour, "_hash": hashed}).join(F.broadcast(needed) if few else needed, ["_hash", "_hour"], "left_semi").drop("_hash", "_hour")


def neighbours(logs: DataFrame, targets: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per target: ``id`` and ``context``, the neighbours in time order around it.

    ``targets`` are some of ``logs``, as a rule the anomalies.
    """
    wanted = _keyed(targets)
    spots = wanted.groupBy(*_KEY, "_t").agg((F.count(F.lit(1)) > 0).alias("_wanted"))
    # stored, as the stretches and the wanted rows are made from it; without that it would be made anew for each
    times = staged(_times(_reachable(_keyed(logs), wanted, reach), reach).join(spots, [*_KEY, "_t"], "left"))
    context = _context(times, "_t", reach, (_SECOND, _HOUR))

    # Payload is joined per key and time, where a log is named a few times at
    # most, and not per target, where one log may be named by very many. The
    # nearest ``reach`` + 1 ids on a side are enough: one of them may be the target.
    def nearest(*refs: str) -> Column:
        return F.slice(F.array_distinct(F.transform(F.concat(*refs), lambda r: r.id)), 1, reach + 1)

    named = context.select(*_KEY, "_t", F.inline(F.array_union(
        F.transform(nearest("last", "before"), lambda i: F.struct(F.lit(False).alias("_later"), i.alias("id"))),
        F.transform(nearest("first", "after"), lambda i: F.struct(F.lit(True).alias("_later"), i.alias("id"))),
    )))
    shown = F.struct(micros(F.col("timestamp")).alias("t"), F.col("id").alias("id"), *SHOWN)
    loaded = named.join(logs.select(F.col("id").cast("long").alias("id"), *SHOWN), "id")
    near = loaded.groupBy(*_KEY, "_t").agg(
        F.collect_list(F.when(~F.col("_later"), shown)).alias("_earlier_logs"),
        F.collect_list(F.when(F.col("_later"), shown)).alias("_later_logs"),
    )
    # From a key and time to its targets by blocks of ids, each of bounded size.
    blocks = wanted.groupBy(*_KEY, "_t", "_block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    found = (
        wanted.join(blocks.join(near, [*_KEY, "_t"]), [*_KEY, "_t", "_block"])
        .groupBy("id")
        .agg(F.flatten(F.collect_list("_earlier_logs")).alias("_before"), F.flatten(F.collect_list("_later_logs")).alias("_after"))
    )

    def others(name: str, ascending: bool) -> Column:
        rest = F.array_distinct(F.filter(name, lambda r: r.id != F.col("id")))
        return F.slice(F.sort_array(rest, asc=ascending), 1, reach)

    def labelled(refs: Column, label: str) -> Column:
        return F.transform(refs, lambda r: F.struct(
            F.lit(label).alias("relative_position"), r.id.alias("id"), *[r[c].alias(c) for c in SHOWN]
        ))

    own = targets.select(F.col("id").cast("long").alias("id"), *SHOWN)
    current = F.array(F.struct(F.lit("CURRENT_ANOMALY").alias("relative_position"), F.col("id").alias("id"), *[F.col(c).alias(c) for c in SHOWN]))
    return own.join(found, "id").select(
        "id",
        F.concat(
            labelled(F.reverse(others("_before", False)), "PREVIOUS"),
            current,
            labelled(others("_after", True), "FOLLOWING"),
        ).alias("context"),
    )


def timeline_rows(found: DataFrame) -> DataFrame:
    """The context exploded: one row per target and neighbour, ``place`` from 0."""
    return found.select(F.col("id").alias("target_id"), F.posexplode("context").alias("place", "c")).select("target_id", "place", "c.*")


def around(logs: DataFrame, log_id: int, reach: int = REACH) -> DataFrame:
    """The context of a single log, by two filtered top-``reach`` scans."""
    target = logs.filter(F.col("id") == log_id).first()
    columns = [F.col("id"), *[F.col(c) for c in SHOWN]]
    if target is None:
        return logs.limit(0).select(F.lit(None).cast("string").alias("relative_position"), *columns)
    time = F.lit(target["timestamp"]).cast("timestamp_ntz")
    near = logs.filter(
        (F.col("id") != log_id)
        & ((F.col("source") == target["source"]) | F.col("ip_address").eqNullSafe(F.lit(target["ip_address"]).cast("string")))
    )

    def part(rows: DataFrame, label: str, place: int) -> DataFrame:
        return rows.select(F.lit(place).alias("_part"), F.lit(label).alias("relative_position"), *columns)

    before = near.filter(F.col("timestamp") <= time).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(reach)
    after = near.filter(F.col("timestamp") >= time).orderBy("timestamp", "id").limit(reach)
    whole = (
        part(before, "PREVIOUS", 0)
        .unionByName(part(logs.filter(F.col("id") == log_id), "CURRENT_ANOMALY", 1))
        .unionByName(part(after, "FOLLOWING", 2))
    )
    return whole.orderBy("_part", "timestamp", "id").drop("_part")

"""Exact count of a source's logs in the five minutes up to each log.

Counted are logs of the same source with a time in ``[t - 300 s, t]`` that do
not come after the log in ``(time, id)`` order.

Logs are first counted per source, time and block of 2**20 ids, with partial
aggregation. Ids are unique, so no block has more rows than that, and a row
number inside the block completes the count. What lies before a block comes from
the counts alone, by *cells* of 10 ms per source: the 30,000 cells before a
block's cell come from a running sum over their counts, and inside a cell the
counts per distinct time are added, less what leaves the window. Each piece is
bounded whatever the data.

Everywhere a log adds to a running sum when it arrives and is taken off again a
span later: one addition per row, where a sliding frame would add up its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom import schema
from logloom.functions.text import micros
from logloom.session import staged

SPAN = schema.WINDOW_SECONDS * 1_000_000
CELL = 10_000
BLOCK_BITS = 20
_STEPS = SPAN // CELL
_PLACE = ["_source", "_t", "_block"]


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def _placed(logs: DataFrame) -> DataFrame:
    """Logs with time in microseconds and the block of their id."""
    time = F.coalesce(micros(F.col("timestamp")), F.lit(0))
    source = F.coalesce("source", F.lit(""))
    return logs.withColumns({"_source": source, "_t": time, "_block": F.shiftright(F.col("id").cast("long"), BLOCK_BITS)})


def blocks(logs: DataFrame) -> DataFrame:
    """``(_source, _t, _block, _n, _base)``: a block's logs and the count before its first one."""
    return _over_cells(_placed(logs).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_n")))


def _with_base(moves: DataFrame, group: str) -> DataFrame:
    """The count before each block of ``moves``, whose other rows only add to the running sum ``_v``."""
    within = Window.partitionBy("_source", group)
    earlier = F.sum("_v").over(within.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1))
    same_time = Window.partitionBy("_source", group, "_t").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    peers = F.coalesce(F.sum("_n").over(same_time), F.lit(0))
    return (
        moves.withColumn("_base", F.coalesce(earlier, F.lit(0)) + peers)
        .filter(F.col("_block").isNotNull())
        .select(*_PLACE, "_n", "_base")
    )


def _move(group: str, at: Column, time: Column, value: Column, own: bool) -> Column:
    nothing = F.lit(None).cast("long")
    return F.struct(
        at.alias(group), time.alias("_t"), (F.col("_block") if own else nothing).alias("_block"),
        (F.col("_n") if own else nothing).alias("_n"), value.alias("_v"),
    )


def _over_cells(counted: DataFrame) -> DataFrame:
    # Logs in the full cells of the span before each cell, as a running sum per
    # source and span-long stretch: cells of this stretch and the last one add
    # to it, and those of the last one leave it a span later.
    cells = counted.groupBy("_source", _div(F.col("_t"), CELL).alias("_cell")).agg(F.sum("_n").alias("_n"))
    stretch = _div(F.col("_cell"), _STEPS)

    def step(place: Column, at: Column, value: Column, own: bool) -> Column:
        return F.struct(place.alias("_stretch"), at.alias("_cell"), value.alias("_v"), F.lit(own).alias("_own"))

    steps = F.inline(F.array(
        step(stretch, F.col("_cell"), F.col("_n"), True),
        step(stretch + 1, F.col("_cell"), F.col("_n"), False),
        step(stretch + 1, F.col("_cell") + _STEPS, -F.col("_n"), False),
    ))
    frame = Window.partitionBy("_source", "_stretch").orderBy("_cell").rangeBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(None).cast("long")
    before = (
        cells.select("_source", steps)
        .withColumn("_v", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
        .filter("_own")
        .select(
            "_source", "_cell", (F.col("_cell") * CELL - 1).alias("_t"), nothing.alias("_block"), nothing.alias("_n"), "_v"
        )
    )
    # Inside a cell arrivals add to the sum and one span later leave it again.
    # The cell's opening value stands just before its first time.
    own, time, number = _div(F.col("_t"), CELL), F.col("_t"), F.col("_n")
    moves = counted.select("_source", F.inline(F.array(
        _move("_cell", own, time, number, True),
        _move("_cell", own + _STEPS, time + SPAN, -number, False),
    )))
    return _with_base(moves.unionByName(before), "_cell")


def with_trailing_count(logs: DataFrame, counted: DataFrame | None = None, name: str = "n_5m") -> DataFrame:
    """Logs with the trailing count; they move once, to their block."""
    base = (blocks(logs) if counted is None else counted).select(*_PLACE, "_base")
    order = Window.partitionBy(*_PLACE).orderBy("id")
    return (
        _placed(logs).join(base, _PLACE)
        .withColumn(name, F.col("_base") + F.row_number().over(order))
        .select(*logs.columns, name)
    )


def histogram(counted: DataFrame) -> DataFrame:
    """``(v, n)``: how many logs have each trailing count, from the blocks alone.

    The logs of a block have the consecutive counts that follow its base.
    """
    values = F.sequence(F.col("_base") + 1, F.col("_base") + F.col("_n"))
    return counted.select(F.explode(values).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def quantile(histogram: DataFrame, q: float, width: int = 1 << 16) -> DataFrame:
    """One row ``(n, value)``: the exact quantile of a histogram of whole numbers, interpolated.

    A coarse histogram tells the two buckets that hold the neighbouring ranks;
    only their values are then ranked. The histogram is read twice, so it is
    staged and what it was made from is not computed again.
    """
    histogram = staged(histogram)
    bucket = _div(F.col("v"), width)
    coarse = histogram.groupBy(bucket.alias("_b")).agg(F.sum("n").alias("_c"))
    running = F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    rank = (F.col("_total") - 1) * F.lit(float(q))
    low, high = F.floor(rank), F.ceil(rank)
    placed = coarse.select(
        "_b", "_c", F.coalesce(running, F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_total")
    )
    needed = placed.filter(
        ((F.col("_start") <= low) & (low < F.col("_start") + F.col("_c")))
        | ((F.col("_start") <= high) & (high < F.col("_start") + F.col("_c")))
    )
    inside = Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("_b", bucket).join(F.broadcast(needed), "_b").withColumn(
        "_end", F.col("_start") + F.sum("n").over(inside)
    )

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_end") > position, F.col("v")))

    picked = ranked.agg(
        F.max("_total").alias("_total"), at(low).alias("_low"), at(high).alias("_high")
    )
    part = rank - F.floor(rank)
    return picked.select(
        F.coalesce("_total", F.lit(0)).alias("n"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("value"),
    )


def burst_threshold(values: DataFrame) -> DataFrame:
    """One row ``threshold`` of a histogram of counts: the 95th percentile, at least 5; 5 below ten logs."""
    found = quantile(values, 0.95)
    return found.select(
        F.when(F.col("n") >= 10, F.greatest("value", F.lit(schema.MIN_BURST))).otherwise(schema.MIN_BURST).alias("threshold")
    )

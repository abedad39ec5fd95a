"""Records of several lines from files that Spark splits by range.

A split holds whole lines, but a record may begin in one split and end in a
later one. Every split is cut into pieces by itself: piece 0 holds the lines that
continue a record from before, pieces 1, 2, ... begin one. Piece 0 is then handed
to the last record before it. So files of any size are read by many tasks, only a
row or two per split are shuffled, and the records do not depend on the split size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import ship, staged

#: What tells splits apart, and the order of a file's splits.
SPLIT = ["_file", "_block"]


def lines_of(reader: DataFrame) -> DataFrame:
    """Lines (``value``) of a text source with the file and split they come from; batch or streaming."""
    return reader.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


#: Bytes of splits that one task goes through, where the splits are smaller.
_TASK = 64 << 20
_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def packed(lines: DataFrame) -> DataFrame:
    """``lines`` of small splits in tasks of some 64 MB, so that each writes a file worth reading.

    The splits stay as they are, each whole and in order within a task.
    """
    spark = lines.sparkSession
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    together = _TASK // max(int(number) << _UNITS[unit], 1)
    if together <= 1:
        return lines
    splits = lines.rdd.getNumPartitions()
    return lines.coalesce(max(-(-splits // together), min(splits, 2 * spark.sparkContext.defaultParallelism), 1))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, tuple, bool]]:
    """Parts of splits in order: file, block, lines, what else a row says, and whether the split begins here."""
    last = None
    for batch in batches:
        files, blocks, lines = (batch.column(k) for k in range(3))
        more = [batch.column(k) for k in range(3, batch.num_columns)]
        if not batch.num_rows:
            continue
        lines = pc.fill_null(lines.cast(pa.string()), "")
        turns = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        borders = [0, *(np.flatnonzero(turns.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(borders, borders[1:]):
            key = (files[begin].as_py(), blocks[begin].as_py())
            yield *key, lines[begin:end], tuple(column[begin].as_py() for column in more), key != last
            last = key


def _joined(lines: pa.Array) -> str:
    return "\n".join(lines.to_pylist())


def pieces(lines: DataFrame, new: Callable[[tuple], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """``_file``, ``_block``, ``_nth``, ``text``: the pieces of every split, stored.

    ``new(extra)`` makes a function for a split, told of further columns of its
    rows, that is given the lines part by part and says of each whether a record
    begins; null skips the line. A task holds a part of the lines and one record.
    """
    ship(lines.sparkSession)

    def made(place: tuple[str, int, int], texts: pa.Array) -> pa.RecordBatch:
        """Pieces of a split from ``place`` on."""
        n = len(texts)
        origin = [pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), pa.array(range(place[2], place[2] + n), pa.int64())]
        return pa.RecordBatch.from_arrays([*origin, texts], [*SPLIT, "_nth", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, begins = None, None, None
        for file, block, part, extra, fresh in _by_split(batches):
            if fresh:
                if held:
                    yield made(place, pa.array(["\n".join(held)], pa.string()))
                place, held, begins = (file, block, 0), [], new(extra)
            first = begins(part)
            if first.null_count:
                part, first = part.filter(first.is_valid()), first.drop_null()
            starts = np.flatnonzero(first.to_numpy(zero_copy_only=False))
            open_end = part[: starts[0]] if len(starts) else part
            if len(open_end):
                held.append(_joined(open_end))
            if not len(starts):
                continue
            if held:
                yield made(place, pa.array(["\n".join(held)], pa.string()))
            if len(starts) > 1:
                groups = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), part)
                yield made((file, block, place[2] + 1), pc.binary_join(groups, "\n"))
            place, held = (file, block, place[2] + len(starts)), [_joined(part[starts[-1] :])]
        if held:
            yield made(place, pa.array(["\n".join(held)], pa.string()))

    return staged(lines.mapInArrow(run, "_file string, _block long, _nth long, text string"))


def whole_records(found: DataFrame) -> DataFrame:
    """``_file``, ``_block``, ``_seq``, ``text`` of every record: open ends joined with the pieces that continue them.

    A piece 0 without any record before it in its file is a record of its own.
    """
    splits = found.groupBy(*SPLIT).agg(F.max("_nth").alias("_last"), F.min("_nth").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("_last") > 0, F.struct(F.col("_block").alias("block"), F.col("_last").alias("nth"))), ignorenulls=True).over(before)
    # splits that only continue what an earlier one of their kind began go to that one
    alone = F.first(F.struct(F.col("_block").alias("block"), F.lit(0).cast("long").alias("nth"))).over(before)
    heads = splits.withColumn("_to", F.coalesce(at, alone)).filter("_first = 0 and _to is not null").select(*SPLIT, "_to")
    heads = staged(heads)
    moved = found.filter("_nth = 0").join(F.broadcast(heads), SPLIT)
    moved = moved.select("_file", F.col("_to.block").alias("_target"), F.col("_to.nth").alias("_nth"), "_block", "text")
    open_ends = heads.select("_file", F.col("_to.block").alias("_block"), F.col("_to.nth").alias("_nth")).distinct()
    joined = found.join(F.broadcast(open_ends), [*SPLIT, "_nth"]).select("_file", F.col("_block").alias("_target"), "_nth", "_block", "text").unionByName(moved)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_block", "text"))), lambda p: p["text"])
    joined = joined.groupBy("_file", "_target", "_nth").agg(F.concat_ws("\n", parts).alias("text"))
    joined = joined.select("_file", F.col("_target").alias("_block"), "_nth", "text")
    rest = found.join(F.broadcast(open_ends), [*SPLIT, "_nth"], "left_anti")
    rest = rest.join(F.broadcast(heads.select(*SPLIT, F.lit(0).cast("long").alias("_nth"))), [*SPLIT, "_nth"], "left_anti")
    return rest.unionByName(joined).withColumnRenamed("_nth", "_seq")


# --- Delimited records: line breaks inside quotes


def ends_open(sep: str) -> Callable[[str, bool], bool]:
    """Whether a quoted cell is still open after a line, by whether one was open before it.

    A quote opens a cell only at its beginning, two quotes within are one sign, and
    any other quote is text. Going on inside quotes is like beginning with one.
    """
    cut = re.escape(sep)
    quoted, plain = '"[^"]*(?:""[^"]*)*+"', f"[^{cut}]*+"
    closed = re.compile(f'(?:(?:{quoted}{plain}|(?!"){plain}){cut})*+"[^"]*+(?:""[^"]*+)*+\\Z')

    def after(line: str, opened: bool) -> bool:
        if '"' not in line:
            return opened
        return closed.match('"' + line if opened else line) is not None

    return after


def start_states(lines: DataFrame, sep: str) -> DataFrame:
    """``_open`` per split: whether its first line continues a quoted cell.

    Each split is gone through under both assumptions. That it ends the same way
    under both fixes its end; otherwise it keeps or turns the state. So the
    state before a split follows from the last fixed end and the turns since.
    """
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, state, place = ends_open(sep), None, None
        names = [*SPLIT, "_closed", "_opened"]
        pack = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*place, *state)))])
        for file, block, part, _, fresh in _by_split(batches):
            if fresh:
                if place:
                    yield pack()
                place, state = (file, block), (False, True)
            for line in part.filter(pc.match_substring(part, '"')).to_pylist():
                state = tuple(after(line, s) for s in state)
        if place:
            yield pack()

    ends = staged(lines.mapInArrow(run, "_file string, _block long, _closed boolean, _opened boolean"))
    order = Window.partitionBy("_file").orderBy("_block")
    turned = ends.withColumn("_turns", F.sum((F.col("_closed") & ~F.col("_opened")).cast("long")).over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.last(F.when(F.col("_closed") == F.col("_opened"), F.struct(F.col("_closed").cast("long").alias("end"), "_turns")), ignorenulls=True).over(before)
    turns = F.coalesce(F.max("_turns").over(before), F.lit(0))
    state = F.coalesce((F.col("_fixed.end") + F.col("_now") - F.col("_fixed._turns")) % 2, F.col("_now") % 2)
    return turned.withColumn("_fixed", fixed).withColumn("_now", turns).select(*SPLIT, (state == 1).alias("_open"))


def delimited_records(lines: DataFrame, sep: str) -> DataFrame:
    """Whole delimited records but blank lines, line breaks inside quotes included; see ``whole_records``."""
    lines = packed(lines)
    states = staged(start_states(lines, sep))

    def new(extra: tuple) -> Callable[[pa.Array], pa.Array]:
        after, opened = ends_open(sep), bool(extra[0])

        def begins(line: str) -> bool | None:
            nonlocal opened
            fresh, opened = not opened, after(line, opened)
            return None if fresh and not line.strip() else fresh

        return lambda part: pa.array([begins(line) for line in part.to_pylist()], pa.bool_())

    told = lines.join(F.broadcast(states), SPLIT).select(*SPLIT, "value", "_open")
    return whole_records(pieces(told, new))

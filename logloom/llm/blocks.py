"""Blocks of vectors asked by a stored table of queries, and inner products without rounding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.files import place
from logloom.session import shared_folder, ship, staged

#: Bytes of vectors in one block: 65,536 vectors of 64 components.
BLOCK_BYTES = 32 << 20
#: Fewest rows worth a task of their own, and rows of queries read at a time.
_LEAST_ROWS, _ASKED = 4096, 512
#: Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def sound(vector: Column) -> Column:
    """False for vectors that are null or hold null or non-finite components."""
    number = vector.cast("array<double>")
    fine = F.forall(number, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of equal length as rows of a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)``: doubles, or Python's integers where a double would overflow."""
    with np.errstate(over="ignore"):
        found = np.floor(values * scale)
    if np.isfinite(found).all():
        return found
    huge = np.abs(values) > EXACT
    flat = [int(x) * int(scale) if h else int(np.floor(x * scale)) for x, h in zip(values.ravel(), huge.ravel())]
    return np.array(flat, dtype=object).reshape(values.shape)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, never below the true ones by more than rounding; infinite beyond double precision."""
    if vectors.dtype == object:
        return np.full(len(vectors), np.inf)
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def products(vectors: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer vectors with a query; ``bound`` is the largest product of two lengths.

    No partial sum exceeds ``bound``, so below 2^53 doubles hold every one of them.
    """
    if bound < EXACT / 2:
        return (vectors @ query).astype(np.int64)
    integers = lambda a: np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape)
    return integers(vectors).dot(integers(query)) if len(vectors) else np.zeros(0, dtype=object)


def longs(values) -> pa.Array:
    """Scores as a column; what no long can hold becomes the nearest long."""
    return pa.array([int(max(-_LONG - 1, min(_LONG, int(v)))) for v in values], pa.int64())


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a stored ``row`` number of their own, so that repeated rows are told apart."""
    return staged(rows.withColumn("row", F.monotonically_increasing_id()))


def past(rows: DataFrame, order: list[Column], asked: DataFrame, build: Callable, answer: Callable, schema: str,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ask every block of ``rows`` all of ``asked``, and return what the answers yield.

    ``rows`` (column ``x``, an array, among others) are sorted over ranges of
    ``order`` into blocks of some ``block_bytes``. A task holds one block at a time:
    ``build(table)`` makes its index once, then the stored queries are read past it
    in small batches, each given to ``answer(index, batch)``, which yields record
    batches of ``schema``. Neither side is copied by a shuffle.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    asked.write.parquet(folder)
    count, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    most = max(64, block_bytes // (8 * max(1, width or 1)))
    tasks = max(-(-count // most), min(spark.sparkContext.defaultParallelism, -(-count // _LEAST_ROWS)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place(folder)
        held, size = [], 0

        def block() -> Iterator[pa.RecordBatch]:
            index = build(pa.Table.from_batches(held).combine_chunks())
            for file in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda f: f.path):
                if file.path.endswith(".parquet"):
                    with system.open_input_file(file.path) as stream:
                        for batch in pq.ParquetFile(stream).iter_batches(batch_size=_ASKED):
                            yield from answer(index, batch)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == most:
                    yield from block()
                    held, size = [], 0
        if size:
            yield from block()

    return rows.repartitionByRange(tasks, *order).mapInArrow(run, schema)

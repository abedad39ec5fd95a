"""Exact top-k inner products with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.blocks import EXACT, lengths, longs, matrix, numbered, past, products, sound, whole

K, EVERY, SCALE = 5, 50, 256
_STEP = 8
_ROUNDS = 8


class Index:
    """Posting segments of a block: for each dimension the rows by quantised impact.

    A segment holds the rows whose component falls in one step of ``_STEP``, with
    the smallest and largest component in it.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        count, width = vectors.shape
        level = vectors // _STEP
        self.rows = np.argsort(level, axis=0, kind="stable").T.ravel()
        dim = np.repeat(np.arange(width), count)
        values, steps = vectors[self.rows, dim], level[self.rows, dim]
        fresh = np.ones(len(dim), dtype=bool)
        fresh[1:] = (dim[1:] != dim[:-1]) | (steps[1:] != steps[:-1])
        self.begin = np.flatnonzero(fresh)
        self.length = np.diff(np.append(self.begin, len(dim)))
        self.dim = dim[self.begin]
        self.low, self.high = np.minimum.reduceat(values, self.begin), np.maximum.reduceat(values, self.begin)
        self.first = np.searchsorted(self.dim, np.arange(width))

    def possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` best; the others are proven not to be.

        Segments are added up by descending impact (their bound above the
        dimension's least). Rows have at most their sum and what the dimensions
        still hold; the k-th largest sum less the width of the steps is reached
        for certain. Work stops when few rows can still reach it, or at the end.
        """
        count = len(self.vectors)
        if count <= k:
            return np.arange(count)
        one, other = query[self.dim] * self.low, query[self.dim] * self.high
        floor = np.minimum.reduceat(np.minimum(one, other), self.first)
        impact = np.maximum(one, other) - floor[self.dim]
        slack = np.maximum.reduceat(np.abs(one - other), self.first).sum()
        order = np.argsort(-impact, kind="stable")
        ends = np.searchsorted(np.cumsum(self.length[order]), np.linspace(0, len(self.rows), _ROUNDS + 1)[1:]) + 1
        sums, done = np.zeros(count), 0
        for end in ends:
            part = order[done:end]
            done = min(end, len(order))
            lengths = self.length[part]
            if len(part):
                at = np.arange(lengths.sum()) + np.repeat(self.begin[part] - (np.cumsum(lengths) - lengths), lengths)
                sums += np.bincount(self.rows[at], weights=np.repeat(impact[part], lengths), minlength=count)
            ahead = np.zeros(len(self.first))
            np.maximum.at(ahead, self.dim[order[done:]], impact[order[done:]])
            certain = np.partition(sums, count - k)[count - k] - slack
            left = np.flatnonzero(sums + ahead.sum() >= certain)
            if len(left) <= max(8 * k, 64):
                break
        return left


def _build(scale: float):
    def build(table: pa.Table) -> dict[int, tuple]:
        """By number of components: ids, row numbers, vectors, longest length and index."""
        width = np.array([len(x) for x in table["x"]])
        made = {}
        for w in np.unique(width):
            part = table.filter(pa.array(width == w)).combine_chunks()
            vectors = whole(matrix(part["x"].combine_chunks(), int(w)), scale)
            most = float(lengths(vectors).max())
            index = Index(vectors) if w and most < EXACT else None
            made[int(w)] = part["vec_id"].to_numpy(), part["row"].to_numpy(), vectors, most, index
        return made

    return build


def _answer(scale: float, k: int):
    def answer(blocks: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, x in zip(batch.column("row").to_pylist(), batch.column("x").to_pylist()):
            if len(x) in blocks:
                ids, rows, vectors, most, index = blocks[len(x)]
                query = whole(np.array(x, dtype=np.float64).reshape(1, -1), scale)
                bound = float(lengths(query)[0]) * most
                own = rows == row
                if index is not None and bound < EXACT / 2:
                    at = index.possible(query[0], k + int(own.sum()))
                else:  # sums of doubles would prove nothing
                    at = np.arange(len(ids))
                at = at[~own[at]]
                scores = products(vectors[at], query[0], bound)
                top = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]])) if scores.dtype == object else np.lexsort((ids[at], -scores))
                out += [(row, ids[at[i]], scores[i]) for i in top[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([int(o[n]) for o in out], pa.int64()) for n in (0, 1)] + [longs(o[2] for o in out)], ["row", "vec_id", "score"])

    return answer


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, **blocks) -> DataFrame:
    """The ``k`` largest integer inner products of every query with all other rows.

    Components become ``floor(scale * x)``. Queries are the rows whose ``vec_id``
    divides by ``every``. Rows are hashed into blocks; each becomes an impact-ordered
    index once, past which all queries are read, and only its ``k`` best per query
    leave the task.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller
    ``vec_id``. Rows with a null id, a null vector, or a null or non-finite component
    take no part. Vectors meet only those of equal length; empty ones score 0.
    Repeated rows, and rows of one id with other vectors, all count, as queries, too.
    Products beyond 2^52 are computed in integers of any size; scores beyond a long
    become the nearest one. Other columns are not read. Empty tables give an empty result.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    clean = numbered(clean.filter(F.col("vec_id").isNotNull() & sound(F.col("x"))))
    asked = clean.filter(F.col("vec_id") % every == 0)
    near = past(clean.select("row", "vec_id", "x"), [F.xxhash64("row")], asked.select("row", "x"), _build(scale), _answer(scale, k), "row long, vec_id long, score long", **blocks)
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    named = asked.select("row", F.col("vec_id").alias("query_id"))
    return best.join(named, "row").select("query_id", "rank", "vec_id", "score")

"""Hard negatives: length buckets with sorted coordinate lists, pruned by the anchor's focus coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.blocks import lengths, longs, matrix, numbered, past, products, sound, whole
from logloom.session import staged

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative scores between these percentages of its positive.
LOW, HIGH = 30, 90
#: Rows of a length bucket, and the coordinates of an anchor whose ranges are intersected.
BUCKET, FOCUS = 2048, 4
#: What rounding may add to a coordinate or a cosine.
_MARGIN = 1e-9


def ranges(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Per coordinate the values that a unit vector can have if its cosine with ``unit`` is ``least`` or more.

    Its angle to an axis differs from that of ``unit`` by at most the angle between the two.
    """
    axis, reach = np.arccos(np.clip(unit, -1, 1)), np.arccos(np.clip(least, -1, 1))
    return np.cos(np.minimum(np.pi, axis + reach)) - _MARGIN, np.cos(np.maximum(0, axis - reach)) + _MARGIN


class Bucket:
    """Rows of one label and similar length, with a sorted list of every coordinate of their directions."""

    def __init__(self, label: str, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, sizes: np.ndarray):
        self.label, self.ids, self.rows, self.vectors = label, ids, rows, vectors
        self.least, self.most = float(sizes.min()), float(sizes.max())
        self.lists = None
        if np.isfinite(self.most):
            self.units = vectors / np.where(sizes > 0, sizes, 1)[:, None]
            self.lists = np.argsort(self.units, axis=0, kind="stable")
            self.values = np.take_along_axis(self.units, self.lists, axis=0)

    def feasible(self, query: np.ndarray, size: float, least: float) -> np.ndarray | None:
        """Places of the rows whose score may reach ``least``; None stands for all of them."""
        if self.lists is None or not np.isfinite(size) or size == 0 or self.least == 0 or not np.isfinite(least):
            return None
        cosine = least / (size * (self.most if least > 0 else self.least)) - _MARGIN
        if cosine > 1:
            return np.zeros(0, dtype=np.int64)
        if cosine <= -1:
            return None
        unit = query / size
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        low, high = ranges(unit[focus], cosine)
        begin = [np.searchsorted(self.values[:, f], a, "left") for f, a in zip(focus, low)]
        end = [np.searchsorted(self.values[:, f], b, "right") for f, b in zip(focus, high)]
        first = int(np.argmin(np.subtract(end, begin)))
        found = self.lists[begin[first] : end[first], focus[first]]
        for other in (k for k in range(len(focus)) if k != first):
            place = self.units[found, focus[other]]
            found = found[(place >= low[other]) & (place <= high[other])]
        return None if len(found) == len(self.ids) else found

    def scores(self, query: np.ndarray, size: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the feasible rows and their exact scores."""
        found = self.feasible(query, size, least)
        part = self.vectors if found is None else self.vectors[found]
        return np.arange(len(self.ids)) if found is None else found, products(part, query, size * self.most)


def _buckets(scale: float):
    def build(table: pa.Table) -> dict[int, list[Bucket]]:
        """Buckets of a block by vector length (number of components), longest rows first."""
        width = np.array([len(x) for x in table["x"]])
        made: dict[int, list[Bucket]] = {}
        for w in np.unique(width):
            part = table.filter(pa.array(width == w)).combine_chunks()
            vectors = whole(matrix(part["x"].combine_chunks(), w), scale)
            sizes = lengths(vectors)
            labels = np.array(part["label"].to_pylist(), dtype=object)
            ids, rows = part["vec_id"].to_numpy(), part["row"].to_numpy()
            for label in sorted(set(labels)):
                at = np.flatnonzero(labels == label)
                at = at[np.argsort(-sizes[at], kind="stable")]
                for some in (at[k : k + BUCKET] for k in range(0, len(at), BUCKET)):
                    made.setdefault(int(w), []).append(Bucket(label, ids[some], rows[some], vectors[some], sizes[some]))
            made[int(w)].sort(key=lambda b: -b.most)
        return made

    return build


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return ids[top], scores[top]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b if not len(a) else np.concatenate([a, b])


def _positives(scale: float, k: int):
    def answer(buckets: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The ``k`` best rows of the anchor's label in a block; the k-th best so far prunes the later buckets."""
        out: list[tuple] = []
        for row, label, x in zip(*(batch.column(c).to_pylist() for c in ("row", "label", "x"))):
            query = whole(np.array(x, dtype=np.float64).reshape(1, -1), scale)
            size, query = float(lengths(query)[0]), query[0]
            ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for bucket in buckets.get(len(x), []):
                if bucket.label == label:
                    at, got = bucket.scores(query, size, float(scores[-1]) if len(ids) == k else -np.inf)
                    other = bucket.rows[at] != row
                    ids, scores = _best(_join(ids, bucket.ids[at][other]), _join(scores, got[other]), k)
            out += [(row, i, s) for i, s in zip(ids, scores)]
        yield pa.RecordBatch.from_arrays([pa.array([int(o[k]) for o in out], pa.int64()) for k in (0, 1)] + [longs(o[2] for o in out)], ["row", "positive_id", "positive_score"])

    return answer


def _negatives(scale: float, k: int, low: int, high: int):
    def answer(buckets: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """For every positive of an anchor the ``k`` best rows of other labels within its window of scores."""
        out: list[tuple] = []
        for row, label, x, near in zip(*(batch.column(c).to_pylist() for c in ("row", "label", "x", "near"))):
            query = whole(np.array(x, dtype=np.float64).reshape(1, -1), scale)
            size, query = float(lengths(query)[0]), query[0]
            windows = {s: (-(-low * s // 100), high * s // 100) for s in {n["positive_score"] for n in near}}
            held = {s: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for s, (a, b) in windows.items() if a <= b}
            for bucket in buckets.get(len(x), []) if held else []:
                if bucket.label != label:
                    least = min(float(got[-1]) if len(got) == k else float(windows[s][0]) for s, (_, got) in held.items())
                    at, got = bucket.scores(query, size, least)
                    for s, (ids, scores) in held.items():
                        fit = (got >= windows[s][0]) & (got <= windows[s][1])
                        if len(scores) == k:
                            fit &= got >= scores[-1]
                        if fit.any():
                            held[s] = _best(_join(ids, bucket.ids[at][fit]), _join(scores, got[fit]), k)
            out += [(row, n["nth"], i, s) for n in near if n["positive_score"] in held for i, s in zip(*held[n["positive_score"]])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(o[k]) for o in out], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))] + [longs(o[3] for o in out)],
            ["row", "nth", "negative_id", "negative_score"])

    return answer


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE, **blocks) -> DataFrame:
    """Rows of other labels that score almost as high as an anchor's own positives.

    ``vectors`` has ``vec_id``, ``embedding``, ``label``. Components become
    ``floor(scale * x)``; a score is the integer inner product with the anchor.
    Anchors are the rows whose ``vec_id`` divides by ``every``; their positives the
    best ``positives`` other rows of the same label; for each positive the best
    ``negatives`` rows of other labels with a score between ``low`` and ``high``
    percent of its score are returned.

    All rows are sorted by length into blocks, these by label and length into
    buckets with a sorted list of every coordinate. A threshold (the worst score
    still wanted) bounds the cosine, the cosine bounds each coordinate; the lists of
    the anchor's largest coordinates give the rows within all these ranges, which
    are scored exactly. Only the best of a block leave its task.

    Rows with a null id or label, a null vector, or a null or non-finite component
    take no part; vectors meet only those of equal length; empty ones score 0.
    Repeated rows count as often as they occur, as anchors, too. Equal scores go by
    ascending ``vec_id``. Labels may have any type. Other columns are not read. An
    empty table gives an empty result. Scores beyond a long become the nearest one.
    """
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding")))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v))
    clean = numbered(clean.select("vec_id", "label", x.alias("x")).withColumn("length", length))
    order = [F.col("length").desc(), F.col("row")]
    anchors = clean.filter(F.col("vec_id") % every == 0)
    rows = clean.select("row", "vec_id", "label", "length", "x")

    near = past(rows, order, anchors.select("row", "label", "x"), _buckets(scale), _positives(scale, positives), "row long, positive_id long, positive_score long", **blocks)
    by = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    near = _first(near, by, "nth", positives)
    listed = near.groupBy("row").agg(F.collect_list(F.struct("nth", "positive_score")).alias("near"))
    asked = anchors.select("row", "label", "x").join(listed, "row")
    found = past(rows, order, asked, _buckets(scale), _negatives(scale, negatives, low, high), "row long, nth int, negative_id long, negative_score long", **blocks)
    by = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    best = _first(found, by, "rank", negatives)
    named = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return best.join(named, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _first(rows: DataFrame, by, name: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered and stored."""
    return staged(rows.withColumn(name, F.row_number().over(by)).filter(F.col(name) <= k))

"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import matrix, sound
from logloom.llm.common import meet
from logloom.llm.components import components
from logloom.session import ship, staged

LEAST = 0.95
#: Reference points, how many nearest ones describe a vector, and how many two vectors must share.
PIVOTS, NEAREST, SHARED = 384, 8, 4
#: Reference points are picked from so many vectors, those alike (by cosine) taken once.
SAMPLE_ROWS, ALIKE = 4096, 0.6
#: Vectors compared at a time, and balls that are paired at a time.
CHUNK = 256
#: What rounding may add to an angle.
_MARGIN = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; the largest component is divided out first, so no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``."""
    return np.einsum("ij,ij->i", unit(a), unit(b))


def pick(sample: list[list[float]], pivots: int, nearest: int, seed: int = 42) -> dict[int, np.ndarray]:
    """Reference points by number of components: sampled vectors that are not alike.

    Where a sample gives few, random directions are added.
    """
    made: dict[int, list[np.ndarray]] = {}
    for vector in sample:
        held = made.setdefault(len(vector), [])
        one = unit(np.array([vector]))[0]
        if len(held) < pivots and (not held or np.max(np.array(held) @ one) < ALIKE):
            held.append(one)
    draw = np.random.default_rng(seed)
    for width, held in made.items():
        while len(held) < 4 * nearest:
            held.append(unit(draw.normal(size=(1, width)))[0])
    return {width: np.array(held) for width, held in made.items()}


def permutation(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the ``nearest`` reference points of each vector, nearest first."""
    near = unit(vectors) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :nearest]


def _posted(rows: DataFrame, by: str, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """Inverted lists: ``by`` and ``key``, once for each set of ``shared`` of a vector's nearest reference points.

    Two vectors stand together in a list if and only if they share that many.
    """
    sets = np.array(list(combinations(range(nearest), shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.array(batch.column(1).value_lengths().to_pylist(), dtype=np.int64)
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                points = pivots.get(int(w))
                if points is None:  # a rare length that the sample missed gets random directions
                    points = pick([[1.0] + [0.0] * (int(w) - 1)], 1, nearest)[int(w)]
                near = np.sort(permutation(matrix(part.column(1), int(w)), points, nearest), axis=1)
                chosen, key = near[:, sets], np.full((part.num_rows, len(sets)), int(w), dtype=np.int64)
                for k in range(shared):
                    key = key * np.int64(len(points) + 1) + chosen[:, :, k]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, len(sets)), pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [by, "keys"])

    return rows.select(by, "x").mapInArrow(run, f"{by} long, keys array<long>").select(by, F.explode("keys").alias("key"))


def _angles(pairs: DataFrame, one: str, two: str, names: list[str]) -> DataFrame:
    """``names`` of ``pairs`` with ``angle`` between the vectors ``one`` and ``two``; lengths that differ give none."""
    schema = ", ".join(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            wa, wb = (np.array(c.value_lengths().to_pylist(), dtype=np.int64) for c in (a, b))
            for w in np.unique(wa[wa == wb]):
                fit = pa.array((wa == w) & (wb == w))
                cos = cosines(matrix(a.filter(fit), int(w)), matrix(b.filter(fit), int(w)))
                kept = [batch.column(k).filter(fit) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(cos), pa.array(np.arccos(np.clip(cos, -1, 1)))], [*names, "cos", "angle"])

    return pairs.select(*names, one, two).mapInArrow(run, f"{schema}, cos double, angle double")


def _balls(classes: DataFrame, least: float, index) -> DataFrame:
    """``classes`` with ``ball`` and ``radius``: a centre so near that any two vectors of a ball are linked for certain.

    A list's leader is its first vector; a vector tries the leader with which it
    shares the most lists. The angle between two vectors is at most
    the sum of their angles to the centre, so half the limit will do.
    """
    posted = staged(index(classes.select("cls", "x"), "cls"))
    lists = staged(posted.groupBy("key").agg(F.min("cls").alias("centre"), F.count("*").alias("_n")).filter("_n > 1"))
    tried = meet(posted, lists.drop("_n"), "key", lists.select("key", "_n")).filter("cls <> centre")
    tried = tried.groupBy("cls", "centre").agg(F.count("*").alias("_lists"))
    tried = staged(tried.groupBy("cls").agg(F.min_by("centre", F.struct(-F.col("_lists"), "centre")).alias("centre")))
    both = meet(tried.join(classes.select("cls", "x"), "cls"), classes.select(F.col("cls").alias("centre"), F.col("x").alias("_x")), "centre")
    near = _angles(both, "x", "_x", ["cls", "centre"]).filter(F.col("angle") <= acos(least) / 2 - _MARGIN)
    near = near.select("cls", F.col("centre").alias("ball"), F.greatest("angle", F.lit(_MARGIN)).alias("radius"))
    joined = classes.join(near, "cls", "left")
    return joined.withColumn("radius", F.coalesce("radius", F.lit(0.0))).withColumn("ball", F.coalesce("ball", "cls"))


def _candidates(posted: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of balls that share a list, each once. Long lists are paired in cells, by many tasks."""
    mixed = staged(posted.groupBy("key").agg(F.min("ball").alias("_lo"), F.max("ball").alias("_hi"), F.count("*").alias("_n")).filter("_lo <> _hi"))
    placed = staged(meet(posted, mixed.select("key"), "key", mixed.select("key", "_n")).distinct())
    cells = staged(placed.groupBy("key").agg(F.count("*").alias("_n")).withColumn("parts", F.ceil(F.col("_n") / CHUNK)))
    rows = meet(placed, cells.drop("_n"), "key", cells.select("key", "_n"))
    part = F.pmod(F.xxhash64("ball"), F.col("parts"))
    rows = rows.withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "turn").alias("i"), F.greatest("part", "turn").alias("j"), "part", "ball")
    of = lambda side: F.collect_list(F.when(F.col("part") == F.col(side), F.col("ball"))).alias(f"_{side}")
    grouped = rows.groupBy("key", "i", "j").agg(of("i"), of("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, size = [], [], 0
            for n in range(batch.num_rows):
                same = batch.column(0)[n].as_py() == batch.column(1)[n].as_py()
                one, two = (batch.column(k)[n].values.to_numpy() for k in (2, 3))
                a, b = np.repeat(one, len(two)), np.tile(two, len(one))
                if same:
                    a, b = a[a < b], b[a < b]
                low.append(np.minimum(a, b))
                high.append(np.maximum(a, b))
                size += len(a)
                if size > 1 << 20 or n == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], ["a", "b"])
                    low, high, size = [], [], 0

    return grouped.select("i", "j", "_i", "_j").mapInArrow(run, "a long, b long").distinct()


def _compared(open_pairs: DataFrame, members: DataFrame, balls: DataFrame, least: float) -> DataFrame:
    """Links between the vectors of pairs of balls that no bound decides: ``cls`` with ``links``, or ``a`` and ``b`` linked.

    Vectors of a ball are stored in chunks; each pair of chunks is one comparison of
    matrices. Only counts leave a task.
    """
    named = open_pairs.select(F.col("a").alias("ball")).unionByName(open_pairs.select(F.col("b").alias("ball"))).distinct()
    sizes = balls.select("ball", F.ceil(F.col("classes") / CHUNK).alias("parts")).join(named, "ball")
    sizes = staged(sizes)
    chosen = meet(members, sizes, "ball").withColumn("part", F.pmod(F.col("h"), F.col("parts")))
    chunks = staged(chosen.groupBy("ball", "part").agg(F.collect_list(F.struct("cls", "size", "x")).alias("_rows")))
    parts = lambda side: sizes.select(F.col("ball").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(f"p{side}"))
    pairs = open_pairs.select("a", "b").join(parts("a"), "a").join(parts("b"), "b")
    for side in "ab":
        pairs = pairs.join(chunks.select(F.col("ball").alias(side), F.col("part").alias(f"p{side}"), F.col("_rows").alias(f"_{side}")), [side, f"p{side}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b, one, two = (batch.column(k)[n].as_py() for k in range(4))
                if len(one[0]["x"]) != len(two[0]["x"]):
                    continue
                x, y = (unit(np.array([r["x"] for r in side])) for side in (one, two))
                hit = x @ y.T >= least
                if hit.any():
                    counts = [(r["cls"], int(c)) for r, c in zip(one, hit @ np.array([r["size"] for r in two]))]
                    counts += [(r["cls"], int(c)) for r, c in zip(two, hit.T @ np.array([r["size"] for r in one]))]
                    counts = [c for c in counts if c[1]]
                    columns = [[c for c, _ in counts] + [None], [k for _, k in counts] + [None], [None] * len(counts) + [a], [None] * len(counts) + [b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "a", "b"])

    return pairs.select("a", "b", "_a", "_b").mapInArrow(run, "cls long, links long, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Link vectors whose cosine is ``least`` or more.

    Reference points are picked from a sample of SAMPLE_ROWS vectors. Every vector
    is described by its ``nearest`` ones and posted in inverted lists; vectors that
    share ``shared`` of them or more are candidates. Equal vectors are one entry.
    Vectors around a common neighbour form a ball, in which all are linked by the
    triangle inequality; pairs of balls are decided by the angle of their centres
    where that proves it, and compared vector by vector elsewhere. So a group of
    near copies is counted, not written out as pairs.

    Returns one row per row of ``vectors`` (``vec_id``, ``embedding``): ``vec_id``,
    ``n_links`` (other rows linked directly), ``component_id`` (smallest ``vec_id``
    reachable) and ``kept`` (it is its own component's name). Null, zero and empty vectors
    and those with null or non-finite components have no links. Repeated rows are
    linked like other equal vectors and share their id. Null ids name a component
    only if it holds no other id; vectors of unequal length have no links. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding").cast("array<double>")
    fine = sound(F.col("embedding")) & F.exists(x, lambda v: v != 0)
    rows = staged(vectors.select("vec_id", F.when(fine, x).alias("x")))
    classes = rows.filter("x is not null").groupBy("x").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    classes = staged(classes.withColumn("h", F.xxhash64("x")).withColumn("cls", F.monotonically_increasing_id()))
    sample = [r.x for r in classes.orderBy("h").limit(SAMPLE_ROWS).select("x").collect()]
    points = pick(sample, pivots, nearest)
    index = lambda table, by: _posted(table, by, points, nearest, shared)

    members = staged(_balls(classes, least, index))
    balls = members.groupBy("ball").agg(F.sum("size").alias("rows"), F.count("*").alias("classes"), F.max("radius").alias("radius"), F.min("least_id").alias("name"))
    balls = staged(balls.join(classes.select(F.col("cls").alias("ball"), "x"), "ball"))
    pairs = staged(_candidates(staged(index(members.select("ball", "x"), "ball"))))
    about = lambda side: balls.select(F.col("ball").alias(side), F.col("radius").alias(f"r{side}"), F.col("x").alias(f"x{side}"))
    near = _angles(meet(meet(pairs, about("a"), "a"), about("b"), "b").withColumn("reach", F.col("ra") + F.col("rb")), "xa", "xb", ["a", "b", "reach"])
    limit = acos(least)
    alone = F.col("reach") == 0
    sure = F.when(alone, F.col("cos") >= least).otherwise(F.col("angle") + F.col("reach") <= limit - _MARGIN)
    maybe = ~alone & ~sure & (F.col("angle") - F.col("reach") <= limit + _MARGIN)
    near = staged(near.withColumn("sure", sure).filter(F.col("sure") | maybe))
    found = staged(_compared(near.filter("not sure"), members, balls, least))

    edges = near.filter("sure").select("a", "b").unionByName(found.filter("a is not null").select("a", "b"))
    roots = components(edges)
    both = near.filter("sure").select("a", "b").unionByName(near.filter("sure").select(F.col("b").alias("a"), F.col("a").alias("b")))
    certain = both.join(balls.select(F.col("ball").alias("b"), "rows"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("rows").alias("_sure"))
    single = found.filter("cls is not null").groupBy("cls").agg(F.sum("links").alias("_single"))
    table = balls.select("ball", "rows", "name").join(certain, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left")
    table = staged(table.withColumn("root", F.coalesce("root", "ball")))
    named = table.groupBy("root").agg(F.min("name").alias("component_id"))
    table = staged(meet(table, named, "root").select("ball", F.col("rows").alias("_rows"), "_sure", "component_id"))
    of_class = meet(members, table, "ball").join(single, "cls", "left")
    links = F.col("_rows") - 1 + F.coalesce("_sure", F.lit(0)) + F.coalesce("_single", F.lit(0))
    of_class = staged(of_class.select("x", links.alias("n_links"), "component_id"))
    out = meet(rows.filter("x is not null"), of_class, "x")
    out = out.select("vec_id", "n_links", "component_id").unionByName(
        rows.filter("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

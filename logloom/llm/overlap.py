"""Near-duplicate texts: fingerprints within a ball, and overlapping sets of word shingles, verified on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import meet, sifted, text_id, workers
from logloom.llm.components import components
from logloom.llm.simhash import SEED, hashes, near_duplicates
from logloom.session import staged

SHINGLE = 5
LEAST = 0.8
#: Two texts at similarity s meet in some band with probability 1 - (1 - s^5)^25: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Two texts of a bucket are compared if so many of their minimum hashes agree; of pairs at 0.8 one in 400 falls short.
LIKELY = 0.7
_CHUNK = 256
#: Rounds that compare with one text per bucket before what is still apart is looked at pair by pair.
_STARS = 1
#: Texts of a bucket that one task looks at together, and pairs that share one copy of a text.
CELL = 256


def _signature(found: np.ndarray, odd: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One number per band, equal for two texts if all minima of the band are; and 32 bits of each minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(found), _CHUNK):
        mixed = (found[None, begin : begin + _CHUNK] ^ mask[:, None]) * odd[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    folded = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        folded = (folded ^ (column >> np.uint64(29)) ^ column) * np.uint64(0x9E3779B97F4A7C15)
        folded ^= folded >> np.uint64(32)
    return folded.view(np.int64), (least >> np.uint64(32)).astype("<u4").tobytes()


def signatures(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """``key``, ``n`` (distinct shingles), ``bands`` and ``minima`` of every row that has words."""
    workers(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        odd, mask = draw.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            kept, sizes, made = [], [], []
            for place, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = np.unique(hashes(text, width, seed))
                if len(found):
                    kept.append(place)
                    sizes.append(len(found))
                    made.append(_signature(found, odd, mask))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array([b for b, _ in made], pa.list_(pa.int64())),
                 pa.array([m for _, m in made], pa.binary())], ["key", "n", "bands", "minima"])

    schema = f"key {_kind(texts)}, n long, bands array<long>, minima binary"
    return texts.select("key", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _kind(table: DataFrame, column: str = "key") -> str:
    return table.schema[column].dataType.simpleString()


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the text of ``side`` as ``_side``. A text of many pairs is laid out once for every CELL of them."""
    counts = staged(pairs.groupBy(side).agg(F.ceil(F.count("*") / CELL).alias("_parts")))
    dealt = pairs.join(counts.filter("_parts > 1"), side, "left")  # few rows: one for every CELL pairs at most
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    copies = texts.select(F.col("key").alias(side), F.col("text").alias(f"_{side}")).join(counts, side)
    copies = copies.select(side, f"_{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    return dealt.join(copies, [side, "_part"]).drop("_part")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """``x``, ``y`` (components) of the pairs that are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            good = []
            for s, t in zip(one, two):
                a, b = set(hashes(s, width, seed).tolist()), set(hashes(t, width, seed).tolist())
                both = len(a & b)
                good.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good, pa.bool_()))

    both = _with_text(_with_text(pairs, texts, "a", "b"), texts, "b", "a")
    return both.select("x", "y", "_a", "_b").mapInArrow(run, f"x {_kind(pairs, 'x')}, y {_kind(pairs, 'y')}").distinct()


def _buckets(rows: DataFrame) -> DataFrame:
    """``key``, ``n``, ``comp``, ``at`` and ``band`` of the texts in buckets that hold more than one component, stored."""
    placed = rows.select("key", "n", "comp", F.posexplode("bands").alias("at", "band"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).filter("_lo <> _hi")
    mixed = staged(mixed.select("band", "_n"))
    some = sifted(placed, "band", mixed).filter("_maybe").drop("_maybe")
    return staged(meet(some, mixed.select("band"), "band", mixed))


def _likely(met: DataFrame, made: DataFrame, least: float, likely: float) -> DataFrame:
    """Pairs of texts that share a bucket, belong to different components, and agree in enough minimum hashes.

    A bucket is cut into cells; a task compares the minimum hashes of a cell as
    matrices and lets out only likely pairs, each in the first bucket it shares.
    """
    mixed = met.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).filter("_lo <> _hi")
    mixed = staged(mixed.select("band", F.ceil(F.col("_n") / CELL).alias("parts"), "_n"))
    held = staged(meet(met, mixed.drop("_n"), "band", mixed.select("band", "_n")))
    some = sifted(made.select("key", "bands", "minima"), "key", staged(held.select("key").distinct())).filter("_maybe").drop("_maybe")
    held = held.join(some.dropDuplicates(["key"]), "key")
    held = held.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = [F.col("at"), F.col("band"), F.least("part", "turn").alias("i"), F.greatest("part", "turn").alias("j")]
    cells = held.groupBy(*cell).agg(F.collect_list(F.struct("part", "n", "key", "comp", "bands", "minima")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                at, i, j = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                table = pa.RecordBatch.from_struct_array(batch.column(3)[k].values)
                part, n = table["part"].to_numpy(), table["n"].to_numpy()
                bands = table["bands"].flatten().to_numpy().reshape(len(n), -1)
                minima = np.frombuffer(b"".join(table["minima"].to_pylist()), dtype="<u4").reshape(len(n), -1)
                comp = table["comp"].dictionary_encode().indices.to_numpy()
                one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)
                for begin in range(0, len(one), 64):
                    some = one[begin : begin + 64]
                    fit = (comp[some][:, None] != comp[two][None]) & ((some[:, None] < two[None]) | (i != j))
                    size = n[some][:, None], n[two][None]
                    fit &= np.minimum(*size) >= np.maximum(*size) * least - 1e-9
                    x, y = np.nonzero(fit)
                    x, y = some[x], two[y]
                    good = ((minima[x] == minima[y]).mean(axis=1) >= likely) & ((bands[x] == bands[y]).argmax(axis=1) == at)
                    if good.any():
                        x, y = pa.array(x[good]), pa.array(y[good])
                        made.append(pa.RecordBatch.from_arrays([table[c].take(p) for c, p in (("key", x), ("key", y), ("comp", x), ("comp", y))], ["a", "b", "x", "y"]))
            yield from made

    kinds = f"a {_kind(met)}, b {_kind(met)}, x {_kind(met, 'comp')}, y {_kind(met, 'comp')}"
    return cells.select("at", "i", "j", "rows").mapInArrow(run, kinds)


def linked(texts: DataFrame, groups: DataFrame, width: int = SHINGLE, least: float = LEAST, seed: int = SEED, likely: float = LIKELY) -> DataFrame:
    """Which components of ``groups`` fall together by pairs of texts with a Jaccard similarity of ``least`` or more.

    ``texts`` has ``key`` (any type, one row per distinct text) and ``text``; ``groups``
    has each ``key`` once with its component ``comp``. Texts meet in buckets of equal
    bands. First one text of each bucket is compared with the others, which joins
    most of a large group; of what is still apart, the likely pairs of a
    bucket are compared. Rows without words (null, empty or blank texts) are left as
    they are; null keys take no part; of repeated rows any may count.
    Only what may matter is shuffled: bands of mixed buckets, and texts and
    minimum hashes that a pair names, see ``sifted``.

    Returns ``node``, ``root`` of the components that join a smaller one.
    """
    made = staged(signatures(texts.filter("key is not null"), width, seed))
    rows = staged(made.select("key", "n", "bands").dropDuplicates(["key"]).join(groups, "key"))
    links, placed = None, _buckets(rows)
    roots = rows.select(F.col("comp").alias("node"), F.col("comp").alias("root")).limit(0)
    for turn in range(_STARS + 1):
        met = placed if links is None else placed.join(roots.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        if turn < _STARS:
            pick = F.min_by(F.struct("key", "n", "comp"), F.xxhash64("key", "band", F.lit(turn))).alias("_o")
            first = met.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), pick, F.count("*").alias("_n")).filter("_lo <> _hi")
            first = staged(first.select("band", F.col("_o.key").alias("b"), F.col("_o.n").alias("_m"), F.col("_o.comp").alias("y"), "_n"))
            pairs = meet(met, first.drop("_n"), "band", first.select("band", "_n")).filter(F.col("comp") != F.col("y"))
            pairs = pairs.filter(F.least("n", "_m") >= F.greatest("n", "_m") * least - 1e-9)
            pairs = pairs.select(F.col("key").alias("a"), "b", F.col("comp").alias("x"), "y").distinct()
        else:
            pairs = _likely(met, made, least, likely)
        pairs = staged(pairs)
        if pairs.isEmpty():
            continue
        wanted = staged(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        some = sifted(texts.select("key", "text"), "key", wanted).filter("_maybe").drop("_maybe")
        some = staged(some.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
        found = _verified(pairs, some, width, least, seed).select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = staged(found if links is None else links.unionByName(found))
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def distinct(docs: DataFrame) -> DataFrame:
    """Keep one row of each group of near duplicates: that with the smallest ``doc_id``, null last; ties go by the text's hash.

    Near are texts whose fingerprints differ in three bits at most, and those
    whose sets of five words in a row have a Jaccard similarity of 0.8 or more; a
    group is what is reachable by such links. Texts are told apart by 128 bits of
    hash, rows by id and text: other texts under the same id, or without one, are
    judged by themselves.

    Returns the columns of ``docs``, whatever they are; only ``doc_id`` and ``text``
    are read. Null, empty and blank texts are near each other. Very long texts are
    read whole. Of repeated rows the one with the smallest values stays. An empty
    table stays empty.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), text_id(F.col("text")).alias("key"), name.alias("name"))
    names = staged(rows.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("_n")))
    texts = _once(rows.select("key", "text"), staged(names.filter("_n > 1").select("key")))
    near = staged(near_duplicates(texts.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("comp")))
    roots = linked(texts, near)
    group = near.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))
    first = names.select("key", "name").join(group, "key").groupBy("comp").agg(F.min(F.struct("name", "key")).alias("_first"))
    mark = lambda name, key: F.unhex(F.md5(F.concat_ws(":", F.hex(key), F.col(f"{name}.id").cast("string")))).alias("mark")
    marked = rows.select("row", mark("name", F.col("key")))
    counts = staged(marked.groupBy("mark").agg(F.count("*").alias("_n")))
    kept = staged(first.select(mark("_first.name", F.col("_first.key"))).join(counts, "mark"))
    other = staged(counts.join(kept.filter("_n = 1"), "mark", "left_anti").select("mark"))  # gone, or one of several rows stays
    marked = sifted(marked, "mark", other)
    moved = marked.filter("_maybe").drop("_maybe")
    once = marked.filter("not _maybe").select("row.*").unionByName(moved.join(kept.filter("_n = 1"), "mark", "left_semi").select("row.*"))
    several = moved.join(kept.filter("_n > 1"), "mark", "left_semi")  # shares the shuffle of the rows with the line above
    order = F.struct(*[F.col("row").getField(c) for c in _sortable(docs)])
    one = several.groupBy("mark").agg(F.min_by("row", order).alias("row"))
    return once.unionByName(one.select("row.*"))


def _once(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``key`` and ``text``, each key once. Only texts of the keys in ``several``, which stand in several rows, are moved."""
    rows = sifted(rows, "key", several)
    moved = staged(rows.filter("_maybe").groupBy("key").agg(F.first("text").alias("text")))
    return rows.filter("not _maybe").select("key", "text").unionByName(moved)


def _sortable(docs: DataFrame) -> list[str]:
    """Columns whose values have an order."""
    return [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]

"""Ranked lexical search: documents that are alike for the items are one bag, scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.blocks import EXACT
from logloom.llm.common import meet, running_total
from logloom.session import ship, staged

K = 10
#: Bytes of the vocabulary that one pass over the bags uses; more items take more passes.
VOCABULARY_BYTES = 16 << 20
#: Cells of the matrix of a block of bags, and scores held at a time.
CELLS = 2 << 20
#: Weights are thousandths of a logarithm; a term adds less than this share of its weight.
_UNIT, _TOP = 1000, 1_000_000

_SIGNS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters and whatever is not ASCII, in UTF-8, with A-Z lower-cased."""
    return (text or b"").translate(_SIGNS).split()


def weight(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(_UNIT * np.log((2 * documents + 2) / (2 * holding + 1)))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item``, ``row``, ``terms`` (array of struct of term and times) of every row that has terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(Counter(terms(t)).items()) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            entries = [[{"term": t, "times": n} for t, n in f] for f in found]
            kind = pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entries, kind)], ["row", "terms"])

    numbered = staged(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    found = numbered.select("row", "text").mapInArrow(run, "row long, terms array<struct<term: binary, times: long>>")
    return staged(numbered.select("item_id", "row").join(found.filter(F.size("terms") > 0), "row"))


def _bags(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id``, ``n`` (terms) and ``bag`` of every document with terms: numbers and counts of the vocabulary's terms, by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {term: k for k, term in enumerate(vocabulary.value)}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sizes, bags = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    found = Counter(terms(text))
                    sizes.append(found.total())
                    bags.append([v for pair in sorted((numbers[t], n) for t, n in found.items() if t in numbers) for v in pair])
                made = [part.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n", "bag"]).filter(pa.array([s > 0 for s in sizes]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, bag array<long>")


def scores(bags: list[np.ndarray], m: np.ndarray, weights: np.ndarray, wanted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of all bags for each of the items ``wanted`` (term numbers and times), one item after another.

    A row of the matrix holds what a term adds to each bag. All numbers are whole;
    while no score can reach 2^53, sums of doubles are exact, else Python's integers serve.
    """
    bag = np.repeat(np.arange(len(bags)), [len(b) // 2 for b in bags])
    flat = np.concatenate(bags) if bags else np.zeros(0, dtype=np.int64)
    term, times = flat[0::2], flat[1::2]
    held, line = np.unique(term, return_inverse=True)
    gain = (1_000_000_000 * times) // (1000 * times + 8 * m[bag]) * weights[term].astype(np.int64)
    cells = np.zeros((len(held), len(bags)))
    cells[line, bag] = gain
    for number, (numbers, count) in enumerate(wanted):
        at = np.searchsorted(held, numbers)
        hit = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == numbers) if len(held) else np.zeros(len(numbers), bool)
        if hit.any():
            if float(weights[numbers] @ count) * _TOP < EXACT / 2:
                yield number, (count[hit].astype(float) @ cells[at[hit]]).astype(np.int64)
            else:
                exact = np.array([[int(v) for v in row] for row in cells[at[hit]]], dtype=object)
                yield number, np.array([int(c) for c in count[hit]], dtype=object).dot(exact)


def _scored(classes: DataFrame, weights, wanted, rows, k: int) -> DataFrame:
    """The ``k`` best bags of each block for each item: ``row``, ``score``, ``cls``, ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, asked, numbers = weights.value, wanted.value, rows.value

        def block(part: pa.RecordBatch, bags: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held = len(np.unique(np.concatenate([b[0::2] for b in bags])))
            if part.num_rows > 1 and held * part.num_rows > CELLS:
                half = part.num_rows // 2
                yield from block(part.slice(0, half), bags[:half])
                yield from block(part.slice(half), bags[half:])
                return
            m, least, cls = (part.column(c).to_numpy(zero_copy_only=False) for c in ("m", "order", "cls"))
            out: list[list] = [[], [], [], []]
            for number, found in scores(bags, m, values, asked):
                good = np.flatnonzero(found > 0)
                if len(good) > 4 * k:
                    good = good[found[good] >= np.partition(found[good], -k)[-k]]
                best = sorted(good, key=lambda i: (-found[i], least[i])) if found.dtype == object else good[np.lexsort((least[good], -found[good]))]
                for i in best[:k]:
                    for column, v in zip(out, (numbers[number], int(found[i]), int(cls[i]), int(least[i]))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "score", "cls", "order"])

        for batch in batches:
            lists = batch.column("bag")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            bags = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield from block(batch, bags)

    return classes.select("bag", "m", "cls", "order").mapInArrow(run, "row long, score long, cls long, order long")


def search(docs: DataFrame, items: DataFrame, k: int = K, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """The ``k`` best documents of every item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. A
    document is reduced to its bag: how often it holds each term of the items'
    vocabulary. Documents with the same bag and the same length factor ``m`` form a
    class, found by hash and verified on the bags. Each class is scored once for
    all items; the best ones are expanded to documents by ascending ``doc_id``.
    With ``N`` documents that have terms, ``L`` terms in all and ``n`` in a document,
    ``m = 25 + (75 n N) div L``; a term in ``df`` documents weighs
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and adds
    ``w * ((10^9 tf) div (1000 tf + 8 m))`` for each of its places in the item.

    Items are taken in groups whose vocabulary fits ``vocabulary_bytes``; only such
    a vocabulary and its items' terms are sent to the tasks.

    Returns ``item_id``, ``rank``, ``doc_id``, ``score``; only scores above 0. Null,
    empty and blank texts have no terms: such documents are not counted, such items
    have no rows. Very long texts are read whole. Equal scores go by ascending
    ``doc_id``, null last. Repeated rows are documents and items of their own; rows
    of a repeated ``item_id`` are ranked by themselves. Other columns are not read.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda total, t: total + F.octet_length(t["term"]) + 64)
    sized = running_total(_item_terms(items).withColumn("_bytes", size), ["row"], "_bytes", "_before")
    sized = staged(sized.withColumn("_group", F.floor(F.col("_before") / vocabulary_bytes)))
    found = [_group(docs, sized.filter(F.col("_group") == g._group), k) for g in sized.select("_group").distinct().orderBy("_group").collect()]
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    result = spark.createDataFrame([], kinds)
    for part in found:
        result = result.unionByName(part)
    return result


def _group(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``search`` for items whose vocabulary has a bounded size."""
    spark = docs.sparkSession
    sent = [(r.row, [(bytes(t.term), t.times) for t in r.terms]) for r in items.select("row", "terms").orderBy("row").collect()]
    names = sorted({term for _, found in sent for term, _ in found})
    vocabulary = spark.sparkContext.broadcast(names)
    numbers = {term: n for n, term in enumerate(names)}
    rows = staged(_bags(docs, vocabulary))
    total = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    m = F.expr(f"cast(25 + (75 * cast(n as decimal(19, 0)) * {total.N}) div {total.L} as long)")
    rows = rows.withColumn("m", m).withColumn("_hash", F.xxhash64("bag", "m"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    classes = rows.groupBy("_hash", "bag", "m").agg(F.min(order).alias("order"), F.count("*").alias("size"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()))
    places = F.filter(F.transform("bag", lambda v, i: F.when(i % 2 == 0, v)), lambda v: v.isNotNull())
    holding = np.zeros(len(names), dtype=np.int64)
    for r in classes.select(F.explode(places).alias("t"), "size").groupBy("t").agg(F.sum("size").alias("df")).collect():
        holding[r.t] = r.df
    weights = spark.sparkContext.broadcast(weight(total.N, holding))
    listed = [(np.array([numbers[t] for t, _ in found]), np.array([n for _, n in found])) for _, found in sent]
    wanted, asked = spark.sparkContext.broadcast(listed), spark.sparkContext.broadcast([row for row, _ in sent])

    best = _scored(classes.filter(F.size("bag") > 0), weights, wanted, asked, k)
    best = best.withColumn("_nth", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "order", "cls"))).filter(F.col("_nth") <= k)
    best = staged(best.drop("_nth", "order"))
    chosen = staged(classes.join(best.select("cls").distinct(), "cls", "left_semi"))
    by_hash = chosen.groupBy("_hash").agg(F.collect_list(F.struct("cls", "bag", "m")).alias("_classes"))
    counts = staged(chosen.groupBy("_hash").agg(F.sum("size").alias("_n")))
    same = meet(rows, staged(by_hash), "_hash", counts).withColumn("_c", F.explode("_classes"))
    same = same.filter((F.col("bag") == F.col("_c.bag")) & (F.col("m") == F.col("_c.m"))).select("_c.cls", "doc_id")
    first = same.withColumn("_nth", F.row_number().over(Window.partitionBy("cls").orderBy(F.asc_nulls_last("doc_id")))).filter(F.col("_nth") <= k)
    members = first.select("cls", "doc_id")
    by = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.join(members, "cls").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")

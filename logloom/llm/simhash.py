"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import sifted, workers
from logloom.llm.components import components
from logloom.session import staged

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Three blocks of bits, of which one at a time is blanked.
_BLOCKS = (range(0, 22), range(22, 43), range(43, 64))


def hashes(text: bytes | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text; fewer words than ``width`` are one."""
    parts = (text or b"").lower().split()  # A-Z and white space of ASCII
    if not parts:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(width)))) if len(parts) >= width else [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype="<u8")


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words."""
    found = hashes(text, width, seed)
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(found), 1 << 15):
        bits = np.unpackbits(found[begin : begin + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` of every row."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _variants(rows: DataFrame, even: list[tuple[int, int]], odd: list[tuple[int, int]]) -> DataFrame:
    """Every row once for each (bits kept, bits flipped) of its parity, with the fingerprint so changed as ``key``."""
    def changes(pairs: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(_signed(k)).alias("kept"), F.lit(_signed(f)).alias("flip")) for k, f in pairs])

    listed = changes(even) if even is odd else F.when(F.bit_count("fp") % 2 == 0, changes(even)).otherwise(changes(odd))
    key = F.col("fp").bitwiseAND(F.col("_c.kept")).bitwiseXOR(F.col("_c.flip"))
    return rows.withColumn("_c", F.explode(listed)).withColumn("key", key).drop("_c")


def _blanked() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What fingerprints with an even and an odd number of set bits emit to meet at three differing bits.

    Three bits apart, one is even and the other odd. If some block holds two or
    three of the bits, blanking it leaves at most one, which the odd side flips.
    Otherwise each block holds one: with the first blanked, the even side flips
    its bit of the second and the odd side its bit of the third.
    """
    whole, even, odd = (1 << 64) - 1, [], []
    for block in _BLOCKS:
        kept = whole ^ sum(1 << b for b in block)
        even.append((kept, 0))
        odd += [(kept, 0)] + [(kept, 1 << b) for b in range(64) if b not in block]
    return even + [(even[0][0], 1 << b) for b in _BLOCKS[1]], odd


def _within(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _linked(prints: DataFrame) -> DataFrame:
    """``node``, ``root`` of the distinct fingerprints ``fp`` that link to others.

    Half the radius is one flip and a half. With one flip from each side two
    fingerprints meet if they differ in two bits at most, and whatever meets is
    linked; at most 65 can share a variant. For the half flip a block of bits is
    blanked, see ``_blanked``; what meets there is verified, and only where it
    isn't yet connected.
    """
    whole = (1 << 64) - 1
    balls = [(whole, 0)] + [(whole, 1 << b) for b in range(64)]
    near = _variants(prints, balls, balls).groupBy("key").agg(F.collect_list("fp").alias("_all")).filter(F.size("_all") > 1)
    first = components(near.select(F.array_min("_all").alias("b"), F.explode("_all").alias("a")).select("a", "b"))

    placed = prints.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("comp"))
    keyed = _variants(staged(placed), *_blanked())
    spans = keyed.repartition("key").groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    mixed = staged(spans.filter("_lo <> _hi").select("key"))
    some = sifted(keyed, "key", mixed).filter("_maybe").drop("_maybe")  # most variants meet nothing and are not shuffled again
    met = staged(some.join(mixed, "key", "left_semi").distinct())
    other = met.select("key", F.col("fp").alias("_fp"), F.col("comp").alias("_comp"))
    pairs = met.join(other, "key").filter((F.col("comp") > F.col("_comp")) & _within(F.col("fp"), F.col("_fp")))
    second = components(pairs.select(F.col("comp").alias("a"), F.col("_comp").alias("b")).distinct())

    joined = first.select("node", F.col("root").alias("_mid")).unionByName(second.select("node", F.col("node").alias("_mid")))
    last = second.select(F.col("node").alias("_mid"), F.col("root").alias("_last"))
    return joined.join(last, "_mid", "left").groupBy("node").agg(F.min(F.coalesce("_last", "_mid")).alias("root"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Link documents whose fingerprints differ in at most three of 64 bits.

    A bit of the fingerprint is set if more than half of the text's word
    shingles (repeats included) have it in their XXH64. Equal fingerprints are
    merged first, so copies cost nothing later; each remaining fingerprint
    emits its variants, these are shuffled, and those that collide are linked.

    Returns one row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex
    digits) and ``component_id`` (smallest doc_id reachable, its own included).
    Null, empty and blank texts have fingerprint zero and link like any other;
    fewer words than ``width`` are one shingle. Repeated rows fall together. Null
    ids are rows like others but never name a component unless it holds no other
    id. Other columns are not read.
    """
    rows = staged(fingerprints(docs, width, seed))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table, but each row becomes a hundred
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")).repartition(tasks, "fp"))
    roots = staged(_linked(prints.select("fp")))
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()).distinct()
    members = staged(members.join(prints, "fp"))
    named = members.groupBy("root").agg(F.min("_least").alias("_name"))
    names = members.join(named, "root").select("fp", "_name")
    table = staged(prints.join(names, "fp", "left").select("fp", F.coalesce("_name", "_least").alias("component_id")))
    return rows.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

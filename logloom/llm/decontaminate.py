"""Benchmark decontamination: which words of a document lie in a passage of a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ascii_lower, small, text_key, words
from logloom.session import staged

WINDOW = 10
SHINGLE = 5
KEY = ["doc_id", "_text"]


def windows(items: DataFrame, size: int, shingle: int) -> DataFrame:
    """``item_id``, ``_window`` (its words), ``_offset``, ``_width`` and ``_hash`` of every shingle of every window."""
    split = items.select("item_id", words(ascii_lower(F.col("text"))).alias("_words")).filter(F.size("_words") > 0)
    starts = split.select("item_id", "_words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_words") - size + 1, F.lit(1)))).alias("_i"))
    cut = starts.select("item_id", F.slice("_words", F.col("_i"), F.lit(size)).alias("_window"))
    cut = cut.distinct().withColumn("_width", F.least(F.size("_window"), F.lit(shingle)))
    placed = cut.select("*", F.explode(F.sequence(F.lit(0), F.size("_window") - F.col("_width"))).alias("_offset"))
    return placed.withColumn("_hash", F.xxhash64(F.slice("_window", F.col("_offset") + 1, F.col("_width"))))


def _hits(docs: DataFrame, shingles: DataFrame, widths: list[int], size: int) -> DataFrame:
    """One row per document (``_width`` 0) and one per place of a benchmark shingle, with the words around it."""
    split = docs.select(
        "doc_id", text_key(F.col("text")).alias("_text"), words(ascii_lower(F.col("text"))).alias("_words")
    ).withColumn("n_words", F.size("_words").cast("long"))
    found = None
    for width in widths or [1]:
        last = F.greatest(F.col("n_words") - width, F.lit(0))
        placed = split.select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_pos"))
        parts = [F.get("_words", F.col("_pos") + k) for k in range(width)]
        placed = placed.withColumn("_hash", F.when(F.col("n_words") >= width, F.xxhash64(F.array(*parts))))
        joined = placed.join(shingles.filter(F.col("_width") == width).select("_hash", "_width"), "_hash", "left")
        first = F.col("_pos") == 0 if width == (widths or [1])[0] else F.lit(False)
        back = F.greatest(F.col("_pos") - (size - width), F.lit(0))
        rows = joined.filter(F.col("_width").isNotNull() | first).select(
            *KEY, "n_words", "_hash", "_width", F.when(first, 1).otherwise(0).alias("_doc"), "_pos", back.alias("_from"),
            F.when(F.col("_width").isNotNull(), F.slice("_words", back + 1, F.lit(2 * size - width))).alias("_near"),
        )
        found = rows if found is None else found.unionByName(rows)
    return staged(found)


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with nulls equal; the keys are taken from ``a``."""
    renamed = b.select(*[F.col(c).alias(f"_b_{c}") if c in keys else F.col(c) for c in b.columns])
    on = [a[c].eqNullSafe(renamed[f"_b_{c}"]) for c in keys]
    joined = a.join(renamed, on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_b_{c}" for c in keys])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Count the words of each document that lie in any occurrence of an item's window.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window. A prefix-filtered set join finds them: the
    shingles of a window are ordered by how rarely they occur in the documents,
    and since a window must be contained whole, its prefix is the single rarest
    shingle. Documents are joined on these prefixes; the shingle's position and
    the document's length bound where the window can start; then the window's
    words are compared with the document's. All texts are read once: the places
    of every benchmark shingle are written with the words around them, counted
    for the order, and joined to the prefixes.

    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``,
    ``n_items``, ``items_sha256``, ``contaminated``. Null and empty texts have no
    words and no hit. Repeated rows each get the same result; other texts under
    the same id are judged by themselves. An empty benchmark hits nothing. Null
    item ids count as no item. Other columns are not read.
    """
    table = staged(windows(items.select("item_id", "text"), size, shingle))
    shingles = table.select("_hash", "_width").distinct()
    widths = [r[0] for r in shingles.select("_width").distinct().orderBy("_width").collect()]
    hits = _hits(docs.select("doc_id", "text"), small(shingles), widths, size)
    places = hits.filter(F.col("_width").isNotNull())
    rarity = places.groupBy("_hash").agg(F.count("*").alias("_n"))
    prefix = (
        table.join(rarity, "_hash")  # a shingle without a place rules its windows out
        .groupBy("item_id", "_window", "_width")
        .agg(F.min(F.struct("_n", "_hash", "_offset")).alias("_rare"), F.count("*").alias("_present"))
        .filter(F.col("_present") == F.size("_window") - F.col("_width") + 1)
        .select("item_id", "_window", "_rare._hash", "_rare._offset")
    )
    start = F.col("_pos") - F.col("_offset")
    bounded = (start >= 0) & (start + F.size("_window") <= F.col("n_words"))
    exact = F.slice("_near", start - F.col("_from") + 1, F.size("_window")) == F.col("_window")
    found = (
        places.join(small(staged(prefix)), "_hash").filter(bounded).filter(exact)
        .select(*KEY, "item_id", start.alias("_start"), F.size("_window").alias("_length")).distinct()
    )
    found = staged(found)
    covered = (
        found.select(*KEY, "_start", "_length").distinct()
        .select(*KEY, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_length") - 1)).alias("_at")).distinct()
        .groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    )
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    listed = found.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(names.alias("_items"))
    result = same(covered, listed, KEY, "left")
    whole = same(hits.filter(F.col("_doc") == 1).select(*KEY, "n_words"), result, KEY, "left")
    items_of = F.coalesce("_items", F.array().cast("array<string>"))
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "_text",
    )

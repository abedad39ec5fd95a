"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import running_total, small
from logloom.llm.decontaminate import same
from logloom.session import staged

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def _size() -> Column:
    """Stretches of a text without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mark(seed: str) -> Column:
    """Where a document stands in its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to ``source``, ``source_size`` by capped water-filling.

    Sources by code point, null last, take the weights in turn. Those whose share
    passes ``epochs`` times their size are clamped there; what they leave is
    shared again by weight among the rest, until none is above.
    """
    keyed = sources.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(keyed, ["_null", "source"], "_one", "_rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    placed = staged(ranked.select("source", "source_size", turn.cast("long").alias("_w"), (epochs * F.col("source_size")).alias("_cap")))
    total, weight = (n or 0 for n in placed.agg(F.sum("source_size"), F.sum("_w")).first())
    left, share = total, weight
    while True:  # each round but the last clamps at least one more source
        over = F.col("_cap") * share <= F.col("_w") * left
        used, gone = (n or 0 for n in placed.filter(over).agg(F.sum("_cap"), F.sum("_w")).first())
        if (left, share) == (total - used, weight - gone):
            break
        left, share = total - used, weight - gone
    reached = F.when(over, F.col("_cap").cast("double")).otherwise((F.col("_w") * left).cast("double") / F.lit(float(max(share, 1))))
    return placed.select("source", "source_size", reached.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words the mix takes of each document.

    A source is repeated whole as often as its target allows. For the rest its
    documents come in the order of a seeded hash of their id, each taken once
    more until the words suffice; the one that reaches the target is taken in
    part, so that a source takes its target rounded to a whole word.

    Returns one row per row of ``docs``: ``doc_id``, ``size``, ``source_size``,
    ``target``, ``taken``, ``whole`` (repetitions of the source), ``copies`` (texts
    to write: the part counts as one from half a text on) and ``source``. Null or empty texts have size and taken 0. Null sources
    are a source of their own, the last. Repeated rows are mixed like others.
    The order of a source is global: its running sum is built over ranges, so
    that no source is gathered in one task.
    """
    counted = staged(docs.select("doc_id", "source", _size().alias("size")))
    sources = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = staged(targets(sources, weights, epochs))
    keyed = counted.withColumns({"_null": F.col("source").isNull().cast("int"), "_mark": _mark(seed)})
    order = ["_null", "source", "_mark", "doc_id", "size"]
    summed = running_total(keyed, order, "size", "_before")
    starts = running_total(plan.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "source_size", "_start")
    joined = same(summed, starts.drop("_null"), ["source"], "inner")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("_whole") * F.col("source_size") - (F.col("_before") - F.col("_start"))))
    taken = F.col("_whole") * F.col("size") + F.col("_part")
    extra = ((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size"))).cast("long")
    return joined.withColumn("_whole", whole).withColumn("_part", part).select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.col("_whole").cast("long").alias("whole"), F.when(F.col("size") > 0, F.col("_whole") + extra).otherwise(1).alias("copies"), "source",
    )


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix writes it, with all their columns.

    In a source's order the documents up to a last one are written once more
    than the others. That place and the whole repetitions are two values per
    source, so the texts are not shuffled. Rows equal in id and size stand at
    one place and are treated alike.
    """
    plan = mix(docs, weights, epochs, seed)
    place = F.struct(_mark(seed).alias("mark"), F.col("doc_id"), F.col("size"))
    more = (F.col("size") > 0) & (F.col("copies") > F.col("whole"))
    cuts = plan.groupBy("source").agg(F.max("whole").alias("_mix_whole"), F.max(F.when(more, place)).alias("_mix_last"))
    cuts = small(staged(cuts.withColumnRenamed("source", "_mix_source")))
    own = F.struct(_mark(seed).alias("mark"), F.col("doc_id"), _size().alias("size"))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("_mix_own"), own.alias("_mix_place"))
    joined = rows.join(cuts, F.col("_mix_own").eqNullSafe(F.col("_mix_source")))
    extra = F.coalesce((F.col("_mix_place") <= F.col("_mix_last")).cast("int"), F.lit(0))
    copies = F.when(F.col("_mix_place.size") > 0, F.col("_mix_whole").cast("int") + extra).otherwise(1)
    turns = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("_mix_turn", F.explode(turns)).select("row.*")

"""Isolation forest after Liu, Ting and Zhou (2008) on samples drawn by Spark.

Each tree sees at most 512 rows, so a tree is built in one small group and all
nodes together are a few ten thousand rows. Scoring is a row-wise Arrow function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom import schema
from logloom.operators.trailing import quantile
from logloom.session import staged

FEATURES = ("f_status", "f_severity", "f_window", "f_source", "f_event", "f_hour", "f_length")
MIN_ROWS = 10
SCALE = 1_000_000  # scores are compared at six decimals
_TOGETHER = 512  # rows that are scored at a time
_NODE = "tree int, node int, feature int, cut double, below int, above int, size int, depth int"


@dataclass(frozen=True)
class Settings:
    trees: int = 50
    sample: int = 512
    seed: int = 42


def feature_columns() -> dict[str, Column]:
    """The seven features; needs ``n_5m``, ``n_source`` and ``n_event``."""
    ordinal = F.lit(1)
    for name, value in schema.SEVERITY_ORDINAL.items():
        ordinal = F.when(F.col("severity") == name, value).otherwise(ordinal)
    values = (
        F.coalesce("status_code", F.lit(0)),
        ordinal,
        F.col("n_5m"),
        F.coalesce("n_source", F.lit(1)),
        F.coalesce("n_event", F.lit(1)),
        F.coalesce(F.hour("timestamp"), F.lit(12)),
        F.coalesce(F.length("message"), F.lit(0)),
    )
    return {name: value.cast("double") for name, value in zip(FEATURES, values)}


def draw(rows: DataFrame, total: int, settings: Settings = Settings()) -> DataFrame:
    """``(tree, id, features)``: per tree a random sample without replacement.

    A row serves the trees for which a hash of its id, the tree and the seed is
    small enough, so the sample does not depend on the partitioning. The trees
    are filtered before the row is repeated: only hits are.
    """
    size = min(settings.sample, total)
    share = min(1.0, (size + 6 * math.sqrt(size) + 10) / total)

    def fraction(tree: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64("id", tree, F.lit(settings.seed)), 11) / F.lit(float(1 << 53))

    trees = F.filter(F.sequence(F.lit(0), F.lit(settings.trees - 1)), lambda tree: fraction(tree) < share)
    picked = rows.withColumn("tree", F.explode(trees)).withColumn("_u", fraction(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_u", "id"))
    return picked.withColumn("_place", place).filter(F.col("_place") <= size).select("tree", "id", *FEATURES)


def _grow(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The nodes of one tree; ``feature`` -1 marks a leaf."""
    rows = rows.sort_values("id")
    values = rows[list(FEATURES)].to_numpy(dtype=np.float64)
    tree = int(rows["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[list] = [[-1, 0.0, -1, -1, len(values), 0]]
    pending = [(0, np.arange(len(values)), 0)]
    while pending:
        at, members, depth = pending.pop()
        low, high = values[members].min(axis=0), values[members].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        under = values[members, feature] <= cut
        children = (members[under], members[~under])
        nodes[at][:4] = [feature, cut, len(nodes), len(nodes) + 1]
        for child in children:
            pending.append((len(nodes), child, depth + 1))
            nodes.append([-1, 0.0, -1, -1, len(child), depth + 1])
    out = pd.DataFrame(nodes, columns=["feature", "cut", "below", "above", "size", "depth"])
    out.insert(0, "node", np.arange(len(nodes)))
    out.insert(0, "tree", tree)
    return out


def grow(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    seed = settings.seed
    return samples.groupBy("tree").applyInPandas(lambda rows: _grow(rows, seed), _NODE)


def _mean_path(size):
    """Average path length of an unsuccessful search among ``size`` rows."""
    size = np.asarray(size, dtype=np.float64)
    more = np.maximum(size, 3)
    general = 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, general))


def scorer(nodes: DataFrame, sample: int):
    """An Arrow function from the feature columns to a score in (0, 1).

    ``nodes`` has at most ``trees * (2 * sample - 1)`` rows, whatever the table's size.
    """
    found = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    # One flat node table; a tree's nodes start at its root. The node above a cut follows the one below it; leaves lead to themselves.
    roots = np.flatnonzero(found["node"].to_numpy() == 0)
    shift = np.repeat(roots, np.diff(np.append(roots, len(found))))
    place = np.arange(len(found))
    leaf = found["feature"].to_numpy() < 0
    low = np.where(leaf, place, found["below"] + shift)
    cut = np.where(leaf, np.inf, found["cut"])
    feature = found["feature"].to_numpy().clip(0)
    path = found["depth"].to_numpy() + _mean_path(found["size"])
    model = nodes.sparkSession.sparkContext.broadcast((feature, cut, low, path, roots))
    norm = float(_mean_path(sample)) or 1.0
    steps = math.ceil(math.log2(max(sample, 2)))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series) -> pd.Series:
        feature, cut, low, lengths, roots = model.value
        rows = np.column_stack([a, b, c, d, e, f, g])
        depth = np.empty(len(rows))
        for begin in range(0, len(rows), _TOGETHER):  # what a step reads stays in the processor's cache
            part = rows[begin : begin + _TOGETHER]
            at, line = np.tile(roots, (len(part), 1)), np.arange(len(part))[:, None] * part.shape[1]
            for _ in range(steps):
                at = low.take(at) + (part.take(line + feature.take(at)) > cut.take(at))
            depth[begin : begin + _TOGETHER] = lengths.take(at).mean(axis=1)
        return pd.Series(np.exp2(-depth / norm))

    return score


@dataclass(frozen=True)
class Fitted:
    """A grown forest: its nodes, rows per tree, and the score above which a row is an outlier."""

    nodes: DataFrame
    sample: int
    limit: float


def _score(nodes: DataFrame, sample: int) -> Column:
    """The score of the feature columns, in whole millionths."""
    return F.round(scorer(nodes, sample)(*FEATURES) * SCALE).cast("long")


def fit(
    rows: DataFrame, total: int, contamination: float = schema.CONTAMINATION, settings: Settings = Settings()
) -> tuple[Fitted, DataFrame]:
    """The forest of ``rows`` (``id`` and features), and ``rows`` with ``_score``.

    Every row is scored once and stored; the limit, the (1 - contamination)
    quantile, is read from the stored scores.
    """
    sample = min(settings.sample, total)
    nodes = staged(grow(draw(rows.select("id", *FEATURES), total, settings), settings))
    scored = staged(rows.withColumn("_score", _score(nodes, sample)))
    return Fitted(nodes, sample, _limit(scored, contamination)), scored


def _limit(scored: DataFrame, contamination: float) -> float:
    histogram = scored.groupBy(F.col("_score").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return float(quantile(histogram, 1 - contamination).first()["value"])


def learn(rows: DataFrame, total: int, contamination: float = schema.CONTAMINATION, settings: Settings = Settings()) -> Fitted:
    """The forest of ``fit`` for rows whose scores nobody wants: only their histogram is stored."""
    sample = min(settings.sample, total)
    nodes = staged(grow(draw(rows.select("id", *FEATURES), total, settings), settings))
    return Fitted(nodes, sample, _limit(rows.select(_score(nodes, sample).alias("_score")), contamination))


def flagged(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """``rows`` plus ``is_outlier`` by an earlier forest."""
    return rows.withColumn("is_outlier", _score(fitted.nodes, fitted.sample) > fitted.limit)


def with_outliers(
    rows: DataFrame, total: int, contamination: float = schema.CONTAMINATION, settings: Settings = Settings()
) -> DataFrame:
    """``rows`` plus ``is_outlier``: score strictly above the (1 - contamination) quantile.

    ``rows`` is read twice and should be a stored table. Fewer than ten rows have
    no outliers.
    """
    if total < MIN_ROWS:
        return rows.withColumn("is_outlier", F.lit(False))
    fitted, scored = fit(rows, total, contamination, settings)
    return scored.withColumn("is_outlier", F.col("_score") > fitted.limit).drop("_score")


def save(fitted: Fitted, path: str) -> None:
    fitted.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    limits = fitted.nodes.sparkSession.createDataFrame([(fitted.sample, fitted.limit)], "sample int, score double")
    limits.write.mode("overwrite").parquet(f"{path}/limit")


def load(spark: SparkSession, path: str) -> Fitted:
    limit = spark.read.parquet(f"{path}/limit").first()
    return Fitted(spark.read.parquet(f"{path}/nodes"), limit["sample"], limit["score"])

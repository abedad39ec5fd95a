"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import workers
from logloom.llm.quality import held_out
from logloom.session import staged

THRESHOLD = 0.3
#: Bounds of the labelled sample that is learned from: documents, and words that stand in them.
SAMPLE_DOCS, SAMPLE_WORDS = 6000, 1_500_000
FOLDS = 5
_ROUNDS, _RATE, _PENALTY = 400, 0.05, 2e-5
_LEAST_DOCS = 3  # a word must stand in as many of the sample
_LEAST_Z = 5.0  # and be more frequent in a category by so many standard errors

# The chain. A toxic document belongs to a category if it holds one of its words; the last one is the label itself.
CATEGORIES = (
    ("insult", frozenset("idiot moron stupid loser clown fool dumb jerk".split())),
    ("contempt", frozenset("trash scum worthless pathetic disgusting filth vermin garbage".split())),
    ("toxic", frozenset()),
)
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[str]:
    """Distinct words of a text in lower case, without ASCII signs."""
    return {w.decode() for w in (text or "").lower().encode().translate(_LETTERS).split()}


@dataclass(frozen=True)
class Sparse:
    """Documents as the numbers of their words, one after the other."""

    numbers: np.ndarray
    lengths: np.ndarray

    def rows(self, chosen: np.ndarray) -> Sparse:
        return Sparse(self.numbers[np.repeat(chosen, self.lengths)], self.lengths[chosen])

    def only(self, wanted: np.ndarray) -> Sparse:
        """The same documents with only the wanted words."""
        keep, doc = wanted[self.numbers], np.repeat(np.arange(len(self.lengths)), self.lengths)
        return Sparse(self.numbers[keep], np.bincount(doc[keep], minlength=len(self.lengths)))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of ``weights`` over each document's words."""
        total = np.concatenate([[0.0], np.cumsum(weights[self.numbers])])
        ends = np.cumsum(self.lengths)
        return total[ends] - total[ends - self.lengths]

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """The sum of the documents' ``values`` for each word."""
        return np.bincount(self.numbers, weights=np.repeat(values, self.lengths), minlength=size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(x: Sparse, labels: np.ndarray, size: int) -> np.ndarray:
    """Words that stand in documents of the category more often than chance allows."""
    inside, everywhere = x.spread(labels, size), x.spread(np.ones(len(labels)), size)
    count, own = len(labels), labels.sum()
    rest, rate = max(count - own, 1.0), np.clip(everywhere / count, 1e-9, 1 - 1e-9)
    gap = inside / max(own, 1.0) - (everywhere - inside) / rest
    return gap >= _LEAST_Z * np.sqrt(rate * (1 - rate) * (1 / max(own, 1.0) + 1 / rest))


def logistic(x: Sparse, earlier: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Weights of the telling words, of the earlier categories and a constant; labels of one kind give the constant alone."""
    found = np.zeros(size + earlier.shape[1] + 1)
    rate = np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4)
    found[-1] = np.log(rate / (1 - rate))
    if not len(labels) or labels.min() == labels.max():
        return found
    first, second, count = np.zeros_like(found), np.zeros_like(found), len(labels)
    x = x.only(telling(x, labels, size))  # the others' weights stay 0
    for k in range(1, _ROUNDS + 1):
        wrong = _sigmoid(x.sums(found[:size]) + earlier @ found[size:-1] + found[-1]) - labels
        slope = np.concatenate([x.spread(wrong, size), earlier.T @ wrong, [wrong.sum()]]) / count
        slope[:-1] += _PENALTY * found[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        found -= _RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return found


@dataclass(frozen=True)
class Model:
    """The chain: numbers of known words, and a column of weights per category."""

    vocabulary: dict[str, int]
    weights: np.ndarray  # words by categories
    links: np.ndarray  # earlier categories by categories
    constants: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, documents by categories; each category sees those before it."""
        known = [[n for n in map(self.vocabulary.get, words(t)) if n is not None] for t in texts]
        x = Sparse(np.array([n for row in known for n in row], dtype=np.int64), np.array([len(row) for row in known], dtype=np.int64))
        found = np.zeros((len(texts), len(self.constants)))
        for k in range(len(self.constants)):
            found[:, k] = _sigmoid(x.sums(self.weights[:, k]) + found[:, :k] @ self.links[:k, k] + self.constants[k])
        return found


def train(texts: list[set[str]], folds: np.ndarray, labels: np.ndarray, categories: tuple = CATEGORIES) -> Model:
    """Fit the chain.

    A category's model is fitted once without each fold; what it then says of
    that fold, out of sample, is what later models learn from. The kept model is
    fitted on all.
    """
    count: dict[str, int] = {}
    for row in texts:
        for word in row:
            count[word] = count.get(word, 0) + 1
    vocabulary = {word: n for n, word in enumerate(sorted(w for w, c in count.items() if c >= _LEAST_DOCS))}
    size = len(vocabulary)
    known = [sorted(vocabulary[w] for w in row if w in vocabulary) for row in texts]
    x = Sparse(np.array([n for row in known for n in row], dtype=np.int64), np.array([len(row) for row in known], dtype=np.int64))
    weights, links, constants = np.zeros((size, len(categories))), np.zeros((len(categories),) * 2), np.zeros(len(categories))
    earlier = np.zeros((len(texts), 0))
    for k, (_, seeds) in enumerate(categories):
        own = labels * np.array([not seeds or not seeds.isdisjoint(row) for row in texts], dtype=np.float64) if len(texts) else labels
        unseen = np.zeros(len(texts))
        if k + 1 < len(categories):
            for fold in range(FOLDS):
                out = folds == fold
                part = logistic(x.rows(~out), earlier[~out], own[~out], size)
                unseen[out] = _sigmoid(x.rows(out).sums(part[:size]) + earlier[out] @ part[size:-1] + part[-1])
        found = logistic(x, earlier, own, size)
        weights[:, k], links[:k, k], constants[k] = found[:size], found[size:-1], found[-1]
        earlier = np.column_stack([earlier, unseen])
    kept = np.abs(weights).max(axis=1, initial=0.0) > 1e-3
    return Model({w: i for i, w in enumerate(w for w, n in vocabulary.items() if kept[n])}, weights[kept], links, constants)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Learn from a bounded sample of labelled documents that aren't held out.

    At most ``sample_docs`` documents, in the order of a hash of their id, come to
    the driver as their distinct words, whole, and of these as many as hold
    ``sample_words`` words.
    """
    workers(docs.sparkSession)
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    present = docs.select("doc_id").distinct().join(known, "doc_id")
    chosen = staged(present.withColumn("_mark", F.md5(F.col("doc_id").cast("string"))).orderBy("_mark", "doc_id").limit(sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [" ".join(sorted(words(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["mark", "toxic", "words"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = staged(joined.select("_mark", F.col("toxic").cast("int"), F.col("text").cast("string").alias("text")).mapInArrow(run, "mark string, toxic int, words string"))
    texts, folds, marks, left = [], [], [], sample_words
    for row in rows.orderBy("mark", "words").toLocalIterator():
        made = {sys.intern(word) for word in row.words.split()}
        if len(made) > left:
            continue
        left -= len(made)
        texts.append(made)
        folds.append(int(row.mark[:8], 16) % FOLDS)
        marks.append(float(row.toxic > 0))
    return train(texts, np.array(folds, dtype=np.int64), np.array(marks))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text, by its words alone.

    Returns one row per row of ``docs``: ``doc_id``, ``held_out``, a probability
    per category of the chain but the last, ``score`` (of the last, toxic) and
    ``predicted`` (1 from ``threshold`` on). Null and empty texts hold no word
    and get the constants. Repeated rows score alike. Labels of one kind, or
    none, give the same score to all. Other columns are not read.
    """
    workers(docs.sparkSession)
    names = [name for name, _ in CATEGORIES[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(2).to_pylist())
            columns = [pa.array(found[:, k], pa.float64()) for k in range(found.shape[1])]
            flags = pa.array((found[:, -1] >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, flags], ["doc_id", "held_out", *names, "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, " + "".join(f"{n} double, " for n in names) + "score double, predicted int"
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

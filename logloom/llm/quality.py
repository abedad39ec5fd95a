"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import workers
from logloom.session import staged

THRESHOLD = 0.3
#: Bounds of the labelled sample that is learned from: documents, and lines in them.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 100_000
_ROUNDS, _RATE, _PENALTY = 150, 0.08, 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOP = b".,;:?'\"-()"
_SIGN = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT + _STOP)
OWN = 16
#: Own features, those of the line before and after, and one for either missing.
WIDTH = 3 * OWN + 2


def _line(line: bytes, before: bytes, seen: set[bytes]) -> list[float]:
    """What a line looks like; every number lies between 0 and about 1."""
    size, words = len(line), line.split()
    count = max(size, 1)
    share = lambda drop: (size - len(line.translate(None, drop))) / count
    number = max(len(words), 1)
    upper, lower = share(_UPPER), share(_LOWER)
    tail = sum(w[-1:] in (b"!", b"#", b"$", b"%", b"&", b"*", b"|") for w in words) / number
    pairs = sum(a == b for a, b in zip(words, words[1:])) / number
    distinct = len(set(words)) / number if words else 1.0
    return [
        1.0, min(np.log1p(size) / 10, 1.5), upper, float(upper > lower), share(_DIGIT), share(_SIGN), min(10 * share(_SIGN), 1.0), tail,
        share(_SPACE), min(size / number / 20, 1.5), distinct, float(distinct < 0.5), pairs, float(line == before and size > 0),
        float(line in seen and size > 0), float(line[-1:] in (b".", b"!", b"?")),
    ]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights (bytes) of all lines, each with those of its neighbours."""
    lines = (text or b"").split(b"\n")
    own, seen, before = np.empty((len(lines), OWN), dtype=np.float32), set(), b""
    for k, line in enumerate(lines):
        own[k] = _line(line, before, seen)
        seen.add(line)
        before = line
    full = np.zeros((len(lines), WIDTH), dtype=np.float32)
    full[:, :OWN] = own
    full[1:, OWN : 2 * OWN] = own[:-1]
    full[:-1, 2 * OWN : 3 * OWN] = own[1:]
    full[0, -2] = full[-1, -1] = 1.0
    return full, np.array([len(line) + 1 for line in lines], dtype=np.float64)


@dataclass(frozen=True)
class Chains:
    """Lines of many documents by place: first lines, second lines and so on, longest documents first."""

    order: np.ndarray
    begin: np.ndarray
    active: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chains:
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        active = np.bincount(place)
        return cls(np.lexsort((rank[doc], place)), np.concatenate([[0], np.cumsum(active)]), active)


def marginals(odds: np.ndarray, jumps: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once.

    ``odds``: score of good against bad per line, by place. Returns the
    probability of good per line, expected counts of the four jumps, and the sum
    of the logarithms of the partition functions.
    """
    scores = np.stack([np.zeros_like(odds), odds], axis=1)
    ahead, back, expected = np.empty_like(scores), np.zeros_like(scores), np.zeros((2, 2))
    for t, n in enumerate(chains.active):
        now = slice(chains.begin[t], chains.begin[t] + n)
        if t == 0:
            ahead[now] = scores[now]
        else:
            old = ahead[chains.begin[t - 1] : chains.begin[t - 1] + n]
            ahead[now] = scores[now] + np.logaddexp(old[:, :1] + jumps[0], old[:, 1:] + jumps[1])
    for t in range(len(chains.active) - 1, 0, -1):
        n = chains.active[t]
        now, old = slice(chains.begin[t], chains.begin[t] + n), slice(chains.begin[t - 1], chains.begin[t - 1] + n)
        come = scores[now] + back[now]
        back[old] = np.logaddexp(jumps[:, 0] + come[:, :1], jumps[:, 1] + come[:, 1:])
    total = np.logaddexp(*(ahead + back).T)
    for t in range(1, len(chains.active)):
        n = chains.active[t]
        now, old = slice(chains.begin[t], chains.begin[t] + n), slice(chains.begin[t - 1], chains.begin[t - 1] + n)
        come = scores[now] + back[now] - total[now][:, None]
        expected += np.exp(ahead[old][:, :, None] + jumps + come[:, None, :]).sum(axis=0)
    good = np.exp(ahead[:, 1] + back[:, 1] - total)
    return good, expected, float(total[: chains.active[0]].sum()) if len(chains.active) else 0.0


@dataclass(frozen=True)
class Model:
    """Weights of the field, and how the length-weighted share of good lines becomes a probability."""

    weights: np.ndarray
    jumps: np.ndarray
    slope: float
    level: float

    def share(self, lines: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(x) for x in lines])
        chains = Chains.of(lengths)
        good = np.empty(lengths.sum())
        good[chains.order] = marginals((np.concatenate(lines) @ self.weights)[chains.order], self.jumps, chains)[0]
        size, starts = np.concatenate(weights), np.cumsum(lengths) - lengths
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        lines, weights = zip(*map(features, texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.share(lines, weights)) + self.level, -30, 30)))


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _adam(start: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x


def train(lines: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit the field to lines that take their document's label, then a logistic curve to the documents."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        level = float(_logit(np.array([np.clip(share, 0.02, 0.98)]))[0])
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, level)
    lengths = np.array([len(x) for x in lines])
    chains = Chains.of(lengths)
    x = np.concatenate(lines).astype(np.float64)[chains.order]
    y = np.repeat(labels, lengths)[chains.order].astype(np.float64)
    stay = np.array([[((lengths - 1) * (labels == 0)).sum(), 0.0], [0.0, ((lengths - 1) * (labels == 1)).sum()]])

    def gradient(p: np.ndarray) -> np.ndarray:
        good, expected, _ = marginals(x @ p[:WIDTH], p[WIDTH:].reshape(2, 2), chains)
        slope = np.concatenate([x.T @ (good - y), (expected - stay).ravel()]) / len(y)
        return slope + _PENALTY * p

    found = _adam(np.zeros(WIDTH + 4), gradient, _ROUNDS, _RATE)
    field = Model(found[:WIDTH], found[WIDTH:].reshape(2, 2), 1.0, 0.0)
    odds = _logit(field.share(lines, weights))

    def curve(p: np.ndarray) -> np.ndarray:
        wrong = 1 / (1 + np.exp(-np.clip(p[0] * odds + p[1], -30, 30))) - labels
        return np.array([(wrong * odds).mean(), wrong.mean()]) + 1e-4 * p

    slope, level = _adam(np.array([0.5, 0.0]), curve, 500, 0.05)
    return Model(field.weights, field.jumps, float(slope), float(level))


def held_out():
    """Documents whose labels are never learned from: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features_of(docs: DataFrame, extra: str) -> DataFrame:
    """``doc_id``, ``extra`` and the line features of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary())],
                [extra, "lines", "weights"])

    return docs.select(F.col(extra).cast("int"), "text").mapInArrow(run, f"{extra} int, lines binary, weights binary")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """Learn from a bounded sample of labelled documents that aren't held out.

    At most ``sample_docs`` documents, in the order of a hash of their id, and of
    these as many as hold ``sample_lines`` lines come to the driver, as features.
    Only these whole texts are read for the fit.
    """
    workers(docs.sparkSession)
    known = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    present = docs.select("doc_id").distinct().join(known, "doc_id")
    chosen = staged(present.withColumn("_mark", F.md5(F.col("doc_id").cast("string"))).orderBy("_mark", "doc_id").limit(sample_docs))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = staged(_features_of(texts.repartition(4), "quality"))
    lines, weights, marks, left = [], [], [], sample_lines
    for row in rows.orderBy(F.md5("lines")).toLocalIterator():
        made = np.frombuffer(row.lines, dtype=np.float32).reshape(-1, WIDTH)
        if len(made) > left:
            continue
        left -= len(made)
        lines.append(made)
        weights.append(np.frombuffer(row.weights))
        marks.append(row.quality)
    return train(lines, weights, np.array(marks, dtype=np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text, by its lines alone.

    Each line gets the probability of being good from forward-backward
    marginals; weighted by length they give the document's share of good lines,
    and a fitted curve its probability. Returns one row per row of ``docs``:
    ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``. Null and empty
    texts are one empty line and are scored too. Repeated rows score alike. An
    empty table or labels of one kind give a model that scores all alike. Other
    columns are not read.
    """
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``threshold``."""
    workers(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(place).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)

import zlib

import numpy as np

from logloom.llm import quality
from tests.llm.helpers import LONG, clashing, docs


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 2])
    chains, jumps, odds = quality.Chains.of(lengths), rng.normal(size=(2, 2)), rng.normal(size=10)
    placed = np.empty(10)
    good, expected, total = quality.marginals(odds[chains.order], jumps, chains)
    placed[chains.order] = good
    want, jumped, logs, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        weights = {}
        for path in np.ndindex(*[2] * n):
            weights[path] = np.exp(sum(odds[at + t] for t in range(n) if path[t]) + sum(jumps[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        logs += np.log(z)
        want += [sum(w for p, w in weights.items() if p[t]) / z for t in range(n)]
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                jumped[a, b] += w / z
        at += n
    assert np.allclose(placed, want) and np.allclose(expected, jumped) and np.isclose(total, logs)


def test_features_use_neighbours():
    full, weight = quality.features(b"one two.\n\nXX !! ## !!")
    own = quality.OWN
    assert full.shape == (3, quality.WIDTH) and list(weight) == [9, 1, 12]
    assert np.array_equal(full[1:, own : 2 * own], full[:-1, :own]) and np.array_equal(full[:-1, 2 * own : 3 * own], full[1:, :own])
    assert quality.features(None)[0].shape == quality.features(b"")[0].shape == (1, quality.WIDTH)


def test_held_out_accuracy(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.score(table, quality.fit(table, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = [truth[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) >= 0.95
    again = quality.score(table.repartition(3), quality.fit(table.repartition(5), labels)).collect()
    assert max(abs(a.score - b.score) for a, b in zip(sorted(rows), sorted(again))) < 1e-6


def test_awkward_rows(spark):
    texts = [None, "", "\n\n", LONG, "Fine words here.", "Fine words here.", "### $$$ ###\n" * 50]
    table = clashing(docs(spark, texts))
    labels = spark.createDataFrame([(i, int(i not in (0, 6)), 0) for i in range(7)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, labels)
    rows = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert len(rows) == 7 and rows[0] == rows[1] and rows[4] == rows[5] and all(0 <= s <= 1 for s in rows.values())
    kept = quality.keep_good(table, model, 0.0)
    assert kept.columns == table.columns and kept.count() == 7
    flat = quality.fit(table, labels.limit(0))
    assert {r.score for r in quality.score(table, flat).collect()} == {0.5}
    one = quality.fit(table, labels.filter("quality = 1"))
    assert len({r.score for r in quality.score(table, one).collect()}) == 1
    assert quality.score(table.limit(0), flat).count() == 0

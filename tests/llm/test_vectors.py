"""Pivot index, hard negatives and top-k against plain re-computations over all pairs."""

import math
import random

import numpy as np
import pytest

from logloom.llm import blocks, negatives, pivots, topk
from tests.llm.helpers import clashing

KIND = "vec_id long, embedding array<double>, label int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def around(rng, centre, cosine):
    """A vector of that cosine with the centre."""
    centre = np.array(centre) / np.linalg.norm(centre)
    other = rng.normal(size=len(centre))
    other -= (other @ centre) * centre
    return (cosine * centre + math.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)).tolist()


def links(rows, least):
    sound = [(i, np.array(v) / np.linalg.norm(np.array(v) / max(map(abs, v))) / max(map(abs, v))) for i, v in rows if fine(v) and any(v)]
    root, near = {k: k for k in range(len(sound))}, [0] * len(sound)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sound)):
        for b in range(a):
            if len(sound[a][1]) == len(sound[b][1]) and sound[a][1] @ sound[b][1] >= least:
                near[a] += 1
                near[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sound):
        groups.setdefault(find(k), []).append(i)
    name = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    linked = [(i, near[k], name[find(k)]) for k, (i, _) in enumerate(sound)]
    return sorted(linked + [(i, 0, i) for i, v in rows if not (fine(v) and any(v))], key=repr)


def test_links_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=24).tolist()) for i in range(60)]
    tight, wide = data[7][1], data[9][1]
    data += [(100 + k, around(rng, tight, 0.998)) for k in range(150)]  # one ball, all linked
    data += [(300 + k, around(rng, wide, 0.97)) for k in range(40)]  # some linked, some not
    data += [(400 + k, list(data[5][1])) for k in range(30)] + [(430, [2 * x for x in data[5][1]]), data[3], data[3]]
    data += [(500, None), (501, [0.0] * 24), (502, [None] * 24), (503, [float("nan")] * 24), (504, [float("inf")] * 24), (505, [])]
    data += [(None, list(data[2][1])), (510, [1e200] + [0.0] * 23), (511, [1e-200] + [0.0] * 23), (520, [1.0, 2.0]), (521, [1.0, 2.01]), (None, None)]
    got = pivots.near_duplicates(clashing(spark.createDataFrame(data, "vec_id long, embedding array<double>"))).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == links(data, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_long_lists_are_paired_in_cells(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 7)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16).tolist()
    data = [(k, around(rng, centre, 0.974)) for k in range(90)]
    got = pivots.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), pivots=32, nearest=12, shared=1).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == links(data, 0.95)


def test_recall_near_the_limit(spark):
    rng = np.random.default_rng(11)
    first = rng.normal(size=(600, 64))
    data = [(2 * k, v.tolist()) for k, v in enumerate(first)] + [(2 * k + 1, around(rng, v, 0.9505)) for k, v in enumerate(first)]
    got = pivots.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.92 * 1200


def test_no_vectors(spark):
    empty = spark.createDataFrame([], KIND)
    assert pivots.near_duplicates(empty).count() == 0
    assert negatives.hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(7, [1.0, 0.0], 1)], KIND)
    assert [tuple(r) for r in pivots.near_duplicates(one).collect()] == [(7, 0, 7, True)]
    assert negatives.hard_negatives(one, every=1).count() == 0


def mined(rows, every, k, n, low, high):
    clean = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and fine(v)]
    found = []
    for a, (i, q, label) in enumerate(clean):
        if i % every == 0:
            scored = [(-sum(x * y for x, y in zip(q, v)), j, other) for b, (j, v, other) in enumerate(clean) if b != a and len(v) == len(q)]
            for s, p, _ in sorted(t for t in scored if t[2] == label)[:k]:
                fit = sorted((t, j) for t, j, other in scored if other != label and low * -s <= 100 * -t <= high * -s)
                found += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(fit[:n], 1)]
    return sorted(found)


@pytest.mark.parametrize("bucket, block_bytes", [(2048, 1 << 20), (5, 64 * 8 * 12)])
def test_negatives_equal_all_comparisons(spark, monkeypatch, bucket, block_bytes):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rng = random.Random(2)
    data = [(i, [rng.gauss(0.1, 0.3) * (1 + i % 3) for _ in range(12)], i % 4) for i in range(-30, 170)]
    data += [(300 + k, list(data[40][1]), k % 3) for k in range(30)] + [data[30], data[30], (0, list(data[31][1]), 2)]
    data += [(400, None, 1), (None, list(data[0][1]), 1), (410, [None] * 12, 1), (420, [float("nan")] * 12, 1), (430, [1.0] * 12, None), (440, [], 1), (450, [], 1), (460, [], 2)]
    data += [(470, [0.0] * 12, 1), (480, [3.0], 1), (481, [2.0], 1), (482, [1.0], 2), (490, [1e6] * 12, 1), (491, [9e5] * 12, 1), (492, [5e5] * 12, 2), (500, [1e7] + [0.5] * 11, 3), (501, [1e7] + [0.25] * 11, 3), (502, [5e6] + [7.0] * 11, 0)]
    data += [(510, [-5.0] * 12, 3), (511, [0.0] * 12, 0)]
    table = clashing(spark.createDataFrame(data, KIND).withColumnRenamed("label", "_l")).drop("label").withColumnRenamed("_l", "label")
    got = negatives.hard_negatives(table.drop("score"), every=10, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == mined(data, 10, 5, 10, 30, 90)


def test_ranges_hold_every_direction():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 5)))
        low, high = negatives.ranges(a, float(a @ b))
        assert ((b >= low) & (b <= high)).all()


def test_focus_prunes():
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(size=(2000, 4)) * 256)
    sizes = blocks.lengths(vectors)
    bucket = negatives.Bucket("a", np.arange(2000), np.arange(2000), vectors, sizes)
    query = vectors[5]
    exact = vectors @ query
    least = float(np.sort(exact)[-10])
    found = bucket.feasible(query, float(sizes[5]), least)
    assert len(found) < 1000 and set(np.flatnonzero(exact >= least)) <= set(found)


def brute(rows, k, every):
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and fine(v)]
    found = []
    for a, (i, q) in enumerate(clean):
        if i % every == 0:
            near = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(clean) if b != a and len(v) == len(q))
            found += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 64 * 8 * 12])
def test_top_k_counts_every_row(spark, block_bytes):
    rng = random.Random(9)
    data = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(150)]
    data += [data[10], data[10], (10, list(data[11][1])), (11, [1e6] * 12), (20, [1e6 - 0.3] * 12), (21, [6e5] + [0.1] * 11), (30, [1e7] + [0.0] * 11), (31, [1e7] + [0.004] * 11)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=10, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == brute(data, 5, 10)

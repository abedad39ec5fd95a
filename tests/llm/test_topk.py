import random

import numpy as np
import pytest

from logloom.llm import topk
from tests.llm.helpers import clashing
from tests.llm.test_vectors import brute


@pytest.mark.parametrize("block_bytes", [32 << 20, 64 * 8 * 12])
def test_equals_all_comparisons(spark, block_bytes):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(-20, 180)]
    data += [(i, list(data[7][1])) for i in range(300, 340)]  # ties
    data += [(400, None), (None, data[0][1]), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, []), (410, [1.0]), (411, [2.0])]
    data += [data[3], data[3], (420, [0.0] * 12), (420, [0.1] * 12)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(clashing(table), every=10, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == brute(data, 5, 10)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-0.5])], kind)).collect()] == [(0, 1, 1, 256 * -128)]


def test_stops_early_on_proof():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-20, 20, (4000, 16)).astype(float)
    query = rng.integers(-20, 20, 16)
    vectors[:9] = np.where(query > 0, 200, -200)
    index = topk.Index(vectors)
    left = index.possible(query, 5)
    exact = vectors @ query
    assert len(left) < 100 and set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(left)

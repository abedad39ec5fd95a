import random

import pytest

from logloom.llm import mixing
from tests.llm.helpers import LONG, clashing, docs


def filled(sizes, weights=(1, 2, 3), epochs=3):
    """Targets by plain water-filling; ``sizes`` in the order of the sources."""
    share = {k: weights[i % 3] for i, k in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in sizes if k not in capped]
        left = total - sum(capped.values())
        level = left / sum(share[k] for k in free) if free else 0
        over = [k for k in free if level * share[k] >= epochs * sizes[k]]
        if not over:
            return capped | {k: level * share[k] for k in free}
        capped |= {k: epochs * sizes[k] for k in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_met(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "c", None]
    sources = [rng.choice(names) for _ in range(80)]
    texts = [rng.choice([None, "", "x " * rng.randint(1, 60), " y\t\nz "]) for _ in sources]
    rows = mixing.mix(clashing(docs(spark, texts, sources))).collect()
    order = sorted((s for s in set(sources) if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    size = {k: sum(len((t or "").split()) for t, s in zip(texts, sources) if s == k) for k in order}
    want = filled(size)
    assert len(rows) == len(texts)
    for k in order:
        mine = [r for r in rows if r.source == k]
        assert all(r.target == pytest.approx(want[k]) and r.source_size == size[k] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[k]) <= 0.5 + 1e-6
    assert all(0 <= r.taken <= 3 * r.size and r.copies <= 3 or r.size == 0 for r in rows)
    again = mixing.mix(docs(spark, texts, sources).repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_awkward_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    rows = mixing.mix(docs(spark, [LONG, "one two", "one two"], ["a", "b", "b"])).collect()
    assert {r.doc_id: r.taken for r in rows if r.source == "b"} == {1: 6, 2: 6}
    assert sum(r.taken for r in rows) == 60_004
    twice = docs(spark, ["a b c"] * 4).withColumn("doc_id", mixing.F.lit(5))
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 12

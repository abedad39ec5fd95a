"""Ranked search against a plain re-computation, and its bags."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logloom.llm import ranked
from tests.llm.helpers import DOCS, LONG, UPPER, clashing, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(texts, items, k):
    bags = [(i, Counter(found(t))) for i, t in texts if found(t)]
    many, total = len(bags), sum(b.total() for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 25 + (75 * bag.total() * many) // total
            score = sum(n * math.floor(1000 * math.log((2 * many + 2) / (2 * holding[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t, n in Counter(found(text)).items() if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


WORDS = [f"w{k}" for k in range(40)] + ["Éclair", "straße", "日本", "x1", "ΣΑΣ", "İx"]


def corpus(rng, n):
    texts = [" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(1, 40))) for _ in range(n)]
    return texts + [texts[3]] * 30 + [texts[4].upper()] * 5 + [None, "", " .,-", "W1-w2_w3'w1\tw2", "no such terms", LONG]


@pytest.mark.parametrize("vocabulary_bytes, cells", [(16 << 20, 2 << 20), (700, 50)])
def test_equals_plain_scores(spark, monkeypatch, vocabulary_bytes, cells):
    monkeypatch.setattr(ranked, "CELLS", cells)
    rng = random.Random(4)
    texts = corpus(rng, 120)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for k in range(12)]
    items += [(50, None), (51, "..."), (52, "never seen"), (53, "w1 w1 w1 W1"), (54, texts[3]), (54, "w2"), (None, "w3 日本")]
    table = docs(spark, texts)
    more = spark.createDataFrame([(None, "w1 w2 w2", "en", "a", 1), (7, "w1 w2 w2", "en", "a", 1), (7, "w1 w2 w2", "en", "a", 1)], DOCS)
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = ranked.search(clashing(table.unionByName(more)), asked, vocabulary_bytes=vocabulary_bytes).collect()
    want = brute(list(enumerate(texts)) + [(None, "w1 w2 w2"), (7, "w1 w2 w2"), (7, "w1 w2 w2")], items, 10)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_no_rows(spark):
    none, some = docs(spark, []), docs(spark, ["a b", "b c"])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(some, items.limit(0)).count() == 0
    assert ranked.search(docs(spark, [None, ""]), items).count() == 0
    assert ranked.search(some, items).count() == 1


def test_scores_past_doubles_are_exact():
    bags, m = [np.array([0, 3, 1, 2]), np.array([1, 5])], np.array([40, 90])
    weights, times = np.array([9000.0, 11.0]), np.array([10**9, 7])
    plain = [sum(int(w) * int(n) * ((10**9 * dict(zip(b[::2], b[1::2]))[t]) // (1000 * dict(zip(b[::2], b[1::2]))[t] + 8 * mm))
                 for t, (w, n) in enumerate(zip(weights, times)) if t in b[::2]) for b, mm in zip(bags, m)]
    assert [int(v) for v in next(ranked.scores(bags, m, weights, [(np.array([0, 1]), times)]))[1]] == plain

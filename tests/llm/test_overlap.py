import random

from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import overlap
from tests.llm.helpers import docs


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited(rng, words, edits):
    copy = list(words)
    for k in rng.sample(range(len(copy)), edits):
        copy[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(copy)


def test_near_copies_from_four_fifths_on_are_dropped(spark):
    rng, texts = random.Random(4), [None, "", "two words"]
    for edits in [0, 1, 2, 3, 4, 5, 6, 8] * 5:
        base = [f"word{rng.randint(0, 20_000)}" for _ in range(250)]
        texts += [" ".join(base), edited(rng, base, edits)]
    pairs = [(a, a + 1) for a in range(3, len(texts), 2)]
    near = [jaccard(texts[a], texts[b]) >= 0.8 for a, b in pairs]
    assert 20 < sum(near) < len(near)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs(spark, texts), "").collect()}
    wrong = [(a, b) for (a, b), n in zip(pairs, near) if n and b in kept]
    assert not wrong and all(a in kept for a, _ in pairs) and sum(b in kept for _, b in pairs) > 0


def test_links_join_components(spark):
    rng = random.Random(5)
    base = [f"word{rng.randint(0, 20_000)}" for _ in range(400)]
    texts = [edited(rng, base, 9) for _ in range(40)] + [" ".join(base), "other words that are near to nothing at all"]
    name = list(range(len(texts)))
    while any(name[i] != name[j] for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8):
        for i in range(len(texts)):
            for j in range(i):
                if jaccard(texts[i], texts[j]) >= 0.8:
                    name[i] = name[j] = min(name[i], name[j])
    table = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    roots = overlap.linked(table, table.selectExpr("key", "key as comp")).collect()
    assert {r.node: r.root for r in roots} == {i: n for i, n in enumerate(name) if i != n}
    assert overlap.linked(table.limit(0), table.limit(0).selectExpr("key", "key as comp")).count() == 0


def test_large_groups_are_looked_at_in_cells(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", 9)
    rng = random.Random(6)
    base = [f"word{rng.randint(0, 20_000)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randint(1, 7)) for _ in range(70)] + [None, "", "   ", "one", "One"]
    name = list(range(len(texts)))
    for i in range(70):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                name = [min(name[i], name[j]) if n in (name[i], name[j]) else n for n in name]
    name[74] = 73
    table = spark.createDataFrame([(f"{i:03}", t, "x") for i, t in enumerate(texts)], "key string, text string, n string")
    roots = overlap.linked(table, table.selectExpr("key", "key as comp")).collect()
    assert {r.node: r.root for r in roots} == {f"{i:03}": f"{n:03}" for i, n in enumerate(name) if i != n}


def test_kept_rows_with_large_groups_and_nulls(spark):
    rng = random.Random(7)
    base = [f"word{rng.randint(0, 20_000)}" for _ in range(120)]
    texts = [" ".join(base)] * 60 + [edited(rng, base, 1) for _ in range(40)] + [None, "", " ", "stays alone for good"]
    kept = overlap.distinct(docs(spark, texts).withColumn("row", F.lit(1)).withColumn("mark", F.lit(2)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, 103] and kept.columns[-2:] == ["row", "mark"]
    assert overlap.distinct(docs(spark, [])).count() == 0

import random

from logloom.llm import components, simhash
from tests.llm.helpers import LONG, clashing, docs


def brute(texts):
    import re

    import xxhash
    from tests.llm.helpers import lowered
    prints = {}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        count = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                count[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))
    return prints, reach(prints)


def reach(prints):
    name = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and name[j] < name[i]:
                    name[i], changed = name[j], True
    return name


def test_equals_all_comparisons(spark):
    rng = random.Random(2)
    base = [f"word{rng.randint(0, 400)}" for _ in range(300)]
    texts = [None, "", " \t ", "Ä b", "ä b", "A b", LONG]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(300)] = f"new{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    prints, name = brute(texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(docs(spark, texts))).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == name
    assert len(set(name.values())) < 60


def test_links_at_every_distance(spark):
    rng, prints, number = random.Random(7), {}, 0
    for _ in range(40):
        centre = rng.getrandbits(64)
        for distance in (0, 1, 2, 3, 3, 3, 4, 6):
            flips = rng.sample(range(64) if rng.random() < 0.7 else range(16), distance)
            prints[number] = centre ^ sum(1 << b for b in flips)
            number += 1
    signed = [simhash._signed(p) for p in dict.fromkeys(prints.values())]
    linked = simhash._linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    root = {r.node: r.root for r in linked}
    want = reach(prints)
    groups = {}
    for i, p in prints.items():
        groups.setdefault(root.get(simhash._signed(p), simhash._signed(p)), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_repeated_rows_and_empty_table(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(5, 6), (7, 7)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 401)} | {6: 5} | {k: 1000 for k in range(1001, 1200)}

"""Published tables: what readers see between the steps of a change, and which cells a change opens."""

import pytest
from pyspark.sql import functions as F

from logloom.operators.published import Conflict, Store
from logloom.plans import sync



def rows(spark, data):
    return spark.createDataFrame(data, "id long, dt string, v string").withColumn("dt", F.col("dt").try_cast("date"))


def seen(store, table="t"):
    found = store.read(table)
    return None if found is None else {r.id: (str(r.dt), r.v) for r in found.collect()}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_upsert_delete_and_clear(spark, root):
    store = Store(spark, root, buckets=4)
    assert seen(store) is None and store.delete("t", rows(spark, [(1, None, "")])) == 0
    store.upsert({"t": rows(spark, [(k, f"2024-01-0{1 + k % 3}" if k % 4 else None, "a") for k in range(20)])})
    change = rows(spark, [(3, "2024-05-05", "moved"), (4, None, "b"), (5, None, "gone dark"), (99, "2024-01-01", "new")])
    for _ in range(2):  # taken again
        store.upsert({"t": change.withColumn("more", F.lit(1))})
    want = {k: (f"2024-01-0{1 + k % 3}" if k % 4 else "None", "a") for k in range(20)}
    want |= {3: ("2024-05-05", "moved"), 4: ("None", "b"), 5: ("None", "gone dark"), 99: ("2024-01-01", "new")}
    assert seen(store) == want and store.read("t").filter("more = 1").count() == 4
    assert store.delete("t", rows(spark, [(3, None, ""), (0, None, ""), (77, None, "")])) == 2
    assert seen(store) == {k: v for k, v in want.items() if k not in (0, 3)}
    assert store.delete("t", rows(spark, [(3, None, "")])) == 0
    assert store.vacuum() > 0 and seen(store) == {k: v for k, v in want.items() if k not in (0, 3)}
    assert store.clear() == 19 and seen(store) == {} and store.read("t").columns == ["id", "dt", "v", "more"]
    store.upsert({"t": rows(spark, [(1, None, "again")])})
    assert seen(store) == {1: ("None", "again")}


def test_newest_of_repeated_keys_counts(spark, root):
    store = Store(spark, root)
    store.upsert({"t": rows(spark, [(1, "2024-01-01", "a"), (1, "2024-01-02", "c"), (1, "2024-01-01", "b")])}, order=F.col("v"))
    assert seen(store) == {1: ("2024-01-02", "c")}


def test_a_failure_between_any_steps_leaves_the_old_state(spark, root):
    first = {"a": rows(spark, [(1, "2024-01-01", "old"), (2, None, "old")]), "b": rows(spark, [(1, "2024-01-01", "old")])}
    second = {"a": rows(spark, [(1, "2024-01-02", "new"), (3, None, "new")]), "b": rows(spark, [(1, None, "new")])}
    steps = []
    Store(spark, root, step=steps.append).upsert(first)
    assert steps[-1] == "published" and len(steps) == 6
    old = seen(Store(spark, root), "a"), seen(Store(spark, root), "b")
    for fatal in steps[:-1]:
        def step(name):
            if name == fatal:
                raise OSError(name)

        with pytest.raises(OSError):
            Store(spark, root, step=step).upsert(second)
        assert (seen(Store(spark, root), "a"), seen(Store(spark, root), "b")) == old
    Store(spark, root).upsert(second)
    assert seen(Store(spark, root), "a") == {1: ("2024-01-02", "new"), 2: ("None", "old"), 3: ("None", "new")}
    assert seen(Store(spark, root), "b") == {1: ("None", "new")}


def test_two_changes_at_once_conflict(spark, root):
    Store(spark, root).upsert({"t": rows(spark, [(1, "2024-01-01", "a")])})
    taken = []

    def meanwhile(name):
        if name == "listed" and not taken:
            taken.append(Store(spark, root).upsert({"t": rows(spark, [(2, "2024-01-01", "b")])}))

    with pytest.raises(Conflict):
        Store(spark, root, step=meanwhile).upsert({"t": rows(spark, [(3, "2024-01-01", "c")])})
    assert set(seen(Store(spark, root))) == {1, 2}


def test_a_small_change_opens_only_its_cells(spark, root):
    store = Store(spark, root, buckets=8)
    store.upsert({"t": rows(spark, [(k, f"2024-01-0{1 + k % 5}", "a") for k in range(200)])})
    before, opened = store.version(), []
    read = Store.read

    class Watched(Store):
        def read(self, table, version=None, cells=None):
            opened.append((table, cells))
            return read(self, table, version, cells)

    Watched(spark, root, buckets=8).upsert({"t": rows(spark, [(7, "2024-01-05", "b")])})
    assert all(cells is not None and len(cells) <= 2 for _, cells in opened)
    after = store.version()
    changed = {c for c in set(before.cells["t"]) | set(after.cells["t"]) if before.cells["t"].get(c) != after.cells["t"].get(c)}
    assert {day for day, _ in changed} == {"2024-01-03", "2024-01-05"} and len({b for _, b in changed}) == 1 and len(changed) == 2
    found = store.read("t", after, changed)
    assert len(found.inputFiles()) == 2 and seen(store)[7] == ("2024-01-05", "b")


def test_cascade_over_stored_targets(spark, root):
    day = "2024-01-01"
    logs = spark.createDataFrame([("l1", day), ("l2", day), ("l3", None)], "id string, dt string").withColumn("dt", F.col("dt").cast("date"))
    anomalies = spark.createDataFrame([("a1", "l1", day), ("a2", "l1", day), ("a3", "l2", day), ("a4", "l3", None)], "id string, log_id string, dt string")
    texts = spark.createDataFrame([("t1", "a1", day), ("t2", "a2", day), ("t3", "a3", day), ("t4", "a4", None)], "id string, anomaly_id string, dt string")
    dated = lambda df: df.withColumn("dt", F.col("dt").cast("date"))
    Store(spark, root).upsert({"logs": logs, "anomalies": dated(anomalies), "ai_analysis": dated(texts)})
    number = Store(spark, root).version().number
    gone = spark.createDataFrame([("l1",), ("l3",), ("none",)], "id string")
    assert sync.delete_logs(spark, root, gone) == {"logs": 2, "anomalies": 3, "ai_analysis": 3}
    assert [[r.id for r in sync.target(spark, root, t).collect()] for t in sync.TARGETS] == [["l2"], ["a3"], ["t3"]]
    assert Store(spark, root).version().number == number + 1
    assert sync.delete_logs(spark, root, gone) == {"logs": 0, "anomalies": 0, "ai_analysis": 0}
    assert Store(spark, root).version().number == number + 1


def test_a_change_taken_again_opens_no_rows_and_leaves_the_keys(spark, root):
    store = Store(spark, root, buckets=4)
    data = [(k, f"2024-01-0{1 + k % 3}" if k % 4 else None, "a") for k in range(40)]
    store.upsert({"t": rows(spark, data).withColumn("more", F.lit(1))})
    before, opened = store.version(), []
    read = Store.read

    class Watched(Store):
        def read(self, table, version=None, cells=None):
            opened.append((table, cells))
            return read(self, table, version, cells)

    Watched(spark, root, buckets=4).upsert({"t": rows(spark, [(k, day, "b") for k, day, _ in data])})
    assert all(not cells for table, cells in opened if table == "t")
    after = store.version()
    assert after.cells["t_keys"] == before.cells["t_keys"] and not set(after.cells["t"].values()) & set(before.cells["t"].values())
    assert seen(store) == {k: (str(day), "b") for k, day, _ in data}
    assert store.read("t").columns == ["id", "dt", "v", "more"] and store.read("t").filter("more is null").count() == 40
    # one key moves and one is new: their buckets alone get new keys, and other rows of their cells stay
    store.upsert({"t": rows(spark, [(1, "2024-02-01", "c"), (99, "2024-01-01", "new")])})
    assert seen(store) == {k: (str(day), "b") for k, day, _ in data} | {1: ("2024-02-01", "c"), 99: ("2024-01-01", "new")}
    assert 0 < sum(path != after.cells["t_keys"][cell] for cell, path in store.version().cells["t_keys"].items()) <= 2
    assert store.delete("t", rows(spark, [(k, None, "") for k in (1, 2, 99)])) == 3 and 1 not in seen(store)


def test_repeated_and_null_keys_are_replaced_and_kept_as_they_come(spark, root):
    store = Store(spark, root, buckets=2)
    twice = [(1, "2024-01-01", "a"), (1, "2024-01-01", "a"), (2, "2024-01-02", "a"), (3, "2024-01-01", "a"), (3, "2024-01-02", "a")]
    for _ in range(2):
        store.upsert({"t": rows(spark, twice)})
    assert sorted((r.id, str(r.dt)) for r in store.read("t").collect()) == sorted((k, d) for k, d, _ in twice)
    store.upsert({"t": rows(spark, [(3, "2024-01-02", "b"), (None, "2024-01-02", "n")])})
    got = sorted(((r.id or 0), str(r.dt), r.v) for r in store.read("t").collect())
    assert got == [(0, "2024-01-02", "n"), (1, "2024-01-01", "a"), (1, "2024-01-01", "a"), (2, "2024-01-02", "a"), (3, "2024-01-02", "b")]
    store.upsert({"t": rows(spark, [(1, "2024-01-01", "c"), (1, "2024-01-01", "d")])})  # as often as there are keys: the others stay
    assert sorted((r.id or 0) for r in store.read("t").collect()) == [0, 1, 1, 2, 3]

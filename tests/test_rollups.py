"""Sums per cell of a published log table: always those of its rows, and made only for the cells of a change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import rollups, stats
from logloom.operators.published import Store
from logloom.operators.tables import with_day

KIND = "id long, timestamp timestamp_ntz, source string, severity string, anomaly boolean, ai_explanation string"


def some_logs(spark, ids, shift=0, source=None):
    levels = ["INFO", "WARNING", "ERROR", "CRITICAL", None, "odd"]

    def row(k):
        at = None if k % 11 == 0 else dt.datetime(2024, 1, 1 + k % 4, 23, 58) + dt.timedelta(seconds=37 * k, days=shift)
        return k, at, source or (None if k % 13 == 0 else f"s{k % 3}"), levels[k % 6], None if k % 17 == 0 else k % 5 == 0, "why" if k % 10 == 0 else None

    return with_day(spark.createDataFrame([row(k) for k in ids], KIND))


def collected(parts):
    ordered = ("recent_anomalies", "anomalies_by_source", "timeline", "sources", "severity_distribution")
    rows = {name: [tuple(r) for r in df.collect()] for name, df in parts.items()}
    return {name: found if name in ordered else sorted(found) for name, found in rows.items()}


def agree(store):
    logs = store.read("logs")
    got, want = collected(rollups.dashboard(store)), collected(stats.dashboard(logs))
    assert got == want
    dated = rollups.timeline(store.rollup("logs"), dated=True).exceptAll(stats.timeline(logs, dated=True))
    assert dated.isEmpty() and sum(r[1] for r in got["timeline_full"]) == logs.filter("timestamp IS NOT NULL").count()
    return got


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_sums_follow_appends_upserts_deletes_and_clearing(spark, root):
    store = rollups.store(spark, root, buckets=2)
    store.upsert({"logs": some_logs(spark, range(200))})
    store.upsert({"logs": some_logs(spark, range(200, 260), shift=2)})
    agree(store)
    for _ in range(2):  # other days, sources and flags for stored rows; taken again
        store.upsert({"logs": some_logs(spark, range(50, 90), shift=30, source="moved").withColumn("anomaly", ~F.col("anomaly"))})
    agree(store)
    assert store.delete("logs", spark.range(0, 260, 3)) == 87
    agree(store)
    assert store.clear() == 173
    assert agree(store)["totals"] == [(0, 0, 0, 0, 0.0, 0.0)]
    store.upsert({"logs": some_logs(spark, range(5))})
    assert agree(store)["totals"][0][0] == 5


def test_an_empty_table_has_empty_sums(spark, root):
    store = rollups.store(spark, root)
    with pytest.raises(LookupError):
        store.rollup("logs")
    assert store.refresh("logs") == 0
    store.upsert({"logs": some_logs(spark, [1]).filter("id < 0")})
    assert agree(store)["totals"] == [(0, 0, 0, 0, 0.0, 0.0)]


def test_a_change_sums_up_only_its_cells(spark, root):
    store = rollups.store(spark, root, buckets=3)
    store.upsert({"logs": some_logs(spark, range(300))})
    before = store.version()
    store.upsert({"logs": some_logs(spark, [7], shift=1)})
    after = store.version()
    changed = lambda t: {c for c in set(before.cells[t]) | set(after.cells[t]) if before.cells[t].get(c) != after.cells[t].get(c)}
    assert changed("logs") == changed("logs_rollup") and len(changed("logs")) == 2
    files = store.rollup("logs").inputFiles()
    assert files and all("logs_rollup" in f for f in files)
    for name, part in rollups.dashboard(store).items():
        assert name == "recent_anomalies" or all("logs_rollup" in f for f in part.inputFiles())


def test_recent_anomalies_read_only_the_newest_days(spark, root):
    store = rollups.store(spark, root, buckets=2)
    store.upsert({"logs": some_logs(spark, range(300))})
    found = rollups.recent(store, 3)
    days = {f.split("_p_day=")[1].split("/")[0] for f in found.inputFiles()}
    newest = stats.recent_anomalies(store.read("logs"), 3)
    assert found.collect() == newest.collect() and len(days) < len({day for day, _ in store.version().cells["logs"]})
    everything = rollups.recent(store, 10_000)  # those without a time come last
    assert everything.collect() == stats.recent_anomalies(store.read("logs"), 10_000).collect()
    assert everything.filter("timestamp IS NULL").count() > 0


def test_cells_changed_without_sums_are_refreshed(spark, root):
    plain = Store(spark, root, buckets=2)
    plain.upsert({"logs": some_logs(spark, range(100))})
    store = rollups.store(spark, root, buckets=2)
    with pytest.raises(LookupError):
        store.rollup("logs")
    assert store.refresh("logs") == len(plain.version().cells["logs"]) and store.refresh("logs") == 0
    plain.upsert({"logs": some_logs(spark, range(3), shift=9)})
    with pytest.raises(LookupError):
        store.rollup("logs")
    cells = len(store.version().cells["logs"])
    assert 0 < store.refresh("logs") < cells
    agree(store)
    plain.delete("logs", spark.range(0, 50))
    store.refresh("logs")
    agree(store)


def test_a_failure_leaves_rows_and_sums_of_one_version(spark, root):
    steps = []
    rollups.store(spark, root, step=steps.append).upsert({"logs": some_logs(spark, range(30))})
    assert "written logs_rollup" in steps
    look = lambda: [sorted(map(str, df.collect())) for df in (store.read("logs"), store.rollup("logs"))]
    store = rollups.store(spark, root)
    old = look()
    for fatal in steps[:-1]:
        def step(name):
            if name == fatal:
                raise OSError(name)

        with pytest.raises(OSError):
            rollups.store(spark, root, step=step).upsert({"logs": some_logs(spark, range(20, 40), shift=1)})
        assert look() == old
    assert store.vacuum() > 0 and look() == old
    agree(store)

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BASE, after, frame, log
from logloom.operators import explorer as x
from logloom.operators import neighbours as nb
from logloom.operators import stats


@pytest.fixture(scope="module")
def twelve(spark):
    rows = [
        (*log(i + 1, after(minutes=i), source=f"source-{i % 3}", severity="INFO" if i < 8 else "ERROR",
              status_code=200 if i < 8 else 500, message=f"Log message number {i}"), i >= 8, 10.0 if i < 8 else 75.0)
        for i in range(12)
    ]
    from logloom import schema
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.LOG) + ", anomaly boolean, anomaly_score double"
    return spark.createDataFrame(rows, kind).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_pages(twelve):
    assert ids(x.page(twelve, 1, 5)) == [12, 11, 10, 9, 8]
    assert ids(x.page(twelve, 3, 5)) == [2, 1]
    assert ids(x.page(twelve, 9, 5)) == []
    assert x.page_info(twelve, 1, 5).first().asDict() == {
        "total": 12, "page": 1, "pages": 3, "per_page": 5, "has_next": True, "has_prev": False,
    }
    assert ids(x.page_after(twelve, after(minutes=7), 8, 3)) == [7, 6, 5]
    assert ids(x.page_after(twelve, after(minutes=7), 8, 3, "asc")) == [9, 10, 11]


def test_pages_reach_rows_without_a_time(twelve):
    untimed = F.when(F.col("id") % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("timestamp"))
    logs = twelve.withColumn("timestamp", F.when(F.col("id") == 7, F.lit(after(minutes=5)).cast("timestamp_ntz")).otherwise(untimed))
    for direction in ("asc", "desc"):
        rows = x.page(logs, 1, 2, direction=direction).collect()
        for _ in range(5):
            rows += x.page_after(logs, rows[-1].timestamp, rows[-1].id, 2, direction).collect()
        assert [r.id for r in rows] == ids(x.sort(logs, "timestamp", direction))
        assert ids(x.page_after(logs, rows[-1].timestamp, rows[-1].id, 2, direction)) == []


def test_filters(twelve):
    assert ids(x.find(twelve, "number 5")) == [6]
    assert len(ids(x.find(twelve, "NUMBER _"))) == 12
    assert len(ids(x.find(twelve, "a\\b"))) == 0
    assert len(ids(x.anomalies_only(twelve, "true"))) == 4
    assert len(ids(x.anomalies_only(twelve, "no"))) == 12
    assert len(ids(x.equals(twelve, "error", "ALL"))) == 4
    assert len(ids(x.date_range(twelve, "2026-08-26", "2026-08-26"))) == 12
    assert len(ids(x.date_range(twelve, "2026-08-27"))) == 0
    assert len(ids(x.date_range(twelve, "soon", "26.08.2026"))) == 12
    assert ids(x.by_id(twelve, 3)) == [3]
    assert sorted(ids(x.by_ids(twelve, [3, 4, 99]))) == [3, 4]


def test_sorting(twelve):
    assert ids(x.sort(twelve, "source", "asc"))[:4] == [1, 4, 7, 10]
    assert ids(x.sort(twelve, "no such column", "up"))[0] == 12
    assert ids(x.sort(twelve, "status_code"))[:4] == [12, 11, 10, 9]


def test_end_of_day_is_the_last_whole_second(spark):
    rows = frame(spark, [log(1, datetime(2026, 8, 26, 23, 59, 59)), log(2, datetime(2026, 8, 26, 23, 59, 59, 500000))])
    assert ids(x.date_range(rows, None, "2026-08-26")) == [1]


def test_dates_prune_partitions(spark, twelve, tmp_path):
    from logloom.operators.tables import append_logs

    append_logs(twelve, str(tmp_path / "t"))
    plan = x.date_range(spark.read.parquet(str(tmp_path / "t")), "2026-08-27")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan


def test_recent_and_first(twelve):
    assert ids(x.recent_anomalies(twelve)) == [12, 11, 10, 9]
    assert ids(x.first_anomalies(twelve, 2)) == [9, 10]
    assert [r.source for r in x.sources(twelve).collect()] == ["source-0", "source-1", "source-2"]


def test_dashboard(twelve):
    parts = stats.dashboard(twelve)
    assert parts["totals"].first().asDict() == {
        "total_logs": 12, "total_anomalies": 4, "critical_anomalies": 0, "ai_analyses_count": 0, "error_rate": 33.3, "anomaly_rate": 33.3,
    }
    assert {r.severity: r.n for r in parts["severity_distribution"].collect()} == {"INFO": 8, "WARNING": 0, "ERROR": 4, "CRITICAL": 0}
    assert [(r.source, r.n) for r in parts["anomalies_by_source"].collect()] == [("source-2", 2), ("source-0", 1), ("source-1", 1)]
    assert len(parts["timeline"].collect()) == 12


def test_empty_dashboard(twelve):
    empty = twelve.limit(0)
    assert stats.totals(empty).first().asDict() == {
        "total_logs": 0, "total_anomalies": 0, "critical_anomalies": 0, "ai_analyses_count": 0, "error_rate": 0.0, "anomaly_rate": 0.0,
    }
    assert [r.n for r in stats.severity_distribution(empty).collect()] == [0, 0, 0, 0]
    assert stats.timeline_sampled(empty).isEmpty()


def test_rate_is_rounded_half_even(spark, twelve):
    rows = twelve.limit(1).select("*").crossJoin(spark.range(400).select(F.col("id").alias("n"))).withColumn(
        "severity", F.when(F.col("n") < 49, "ERROR").otherwise("INFO"))
    assert stats.totals(rows).first().error_rate == 12.2  # 12.25


def test_timeline_is_sampled_not_merged(spark):
    rows = frame(spark, [log(i, after(minutes=i)) for i in range(60)]).withColumn("anomaly", F.col("id") % 2 == 0)
    found = stats.timeline_sampled(rows).collect()
    assert [r.bucket for r in found][:3] == ["08-26 10:00", "08-26 10:03", "08-26 10:06"]
    assert len(found) == 20 and all(r.total == 1 for r in found)


def expected_context(rows, row):
    near = [o for o in rows if o[0] != row[0] and (o[2] == row[2] or o[3] == row[3])]
    before = sorted([o for o in near if o[1] <= row[1]], key=lambda o: (o[1], o[0]), reverse=True)[:3][::-1]
    later = sorted([o for o in near if o[1] >= row[1]], key=lambda o: (o[1], o[0]))[:3]
    return [("PREVIOUS", o[0]) for o in before] + [("CURRENT_ANOMALY", row[0])] + [("FOLLOWING", o[0]) for o in later]


@pytest.mark.parametrize("bits", [20, 2])
def test_neighbours_equal_brute_force(spark, monkeypatch, bits):
    """A third of the rows share one source and time; others are hours apart."""
    monkeypatch.setattr(nb, "BLOCK_BITS", bits)
    pick = random.Random(bits)
    rows = []
    for i in range(360):
        offset = pick.choice([pick.randrange(90_000) * 1_000_000, 7_000_000, 7_000_001, pick.randrange(5_000_000)])
        at = BASE if i % 3 == 0 else BASE + timedelta(microseconds=offset)
        rows.append((i, at, "hot" if i % 3 == 0 else pick.choice("abc"), pick.choice(["1", "2", None]), "INFO", 200, f"m{i}"))
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, source string, ip_address string, severity string, status_code int, message string").cache()
    targets = df.filter("id % 4 = 0")
    found = {r.id: [(c.relative_position, c.id) for c in r.context] for r in nb.neighbours(df, targets).collect()}
    assert found == {r[0]: expected_context(rows, r) for r in rows if r[0] % 4 == 0}
    one = nb.around(df, 5).collect()
    assert [(r.relative_position, r.id) for r in one] == expected_context(rows, rows[5])
    assert nb.around(df, 10_000).isEmpty()

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BASE, after, frame, log
from logloom import schema
from logloom.operators import forest, profile, skew, trailing
from logloom.plans import detect as d


def scores(df):
    return {r.id: r for r in df.collect()}


def test_high_risk_location(spark):
    row = log(1, source="gateway-k", event_type="PUT", severity="ERROR", status_code=500,
              message="stored nothing | Location: North Korea | shelf 12")
    found = d.detect(frame(spark, [row])).first()
    assert (found.anomaly, found.anomaly_score) == (True, 90.0)
    assert found.anomaly_reason == (
        "Flagged with anomaly score 90/100 because the log originates from high-risk/anomalous geographic location 'North Korea', "
        "has ERROR severity level, returned HTTP server error 500, is an unusual event type 'PUT' (occurring in <=1% of logs)."
    )


def test_score_is_capped(spark):
    row = log(2, source="ledger", severity="CRITICAL", status_code=500, message="book closed | Location: North Korea")
    found = d.detect(frame(spark, [row])).first()
    assert found.anomaly_score == 100.0 and "CRITICAL severity" in found.anomaly_reason


def test_normal_rows_are_not_flagged(spark):
    rows = [log(i, after(minutes=2 * i), source="shelf", message=f"book number {i} lent") for i in range(15)]
    for r in d.detect(frame(spark, rows)).collect():
        assert not r.anomaly and r.anomaly_score < 50 and "Normal log activity" in r.anomaly_reason


def test_threshold_and_weights(spark):
    row = frame(spark, [log(99, severity="ERROR", message="passes by")])
    assert [(r.anomaly, r.anomaly_score) for r in d.detect(row).collect()] == [(False, 20.0)]
    assert d.detect(row, 15).first().anomaly
    assert d.detect(row, weights={"severity_error": 45}).first().anomaly_score == 55.0
    plain = frame(spark, [log(i, after(minutes=10 * i)) for i in range(3)])
    found = d.detect(plain, 0).first()
    assert found.anomaly and found.anomaly_reason == "Flagged with anomaly score 0/100 exceeding threshold of 0."


def burst_rows():
    rows = [log(i, after(minutes=5 * i), source="shelf", message="one book lent") for i in range(20)]
    return rows + [
        log(100 + j, after(3600 + 2 * j), source="door", event_type="KEY_TURNED", severity="WARNING", status_code=401, message="the wrong key again")
        for j in range(15)
    ]


def test_burst_signal(spark):
    logs = frame(spark, burst_rows())
    found = {(r.id, r.code) for r in d.signals(logs, use_forest=False).collect()}
    # the 95th percentile of the counts is 13.3: only the last two rows of the burst reach it
    assert {i for i, code in found if code == "FREQUENCY_BURST"} == {113, 114}


def test_burst_is_flagged_for_most_seeds(spark):
    logs = frame(spark, burst_rows())
    profiled = profile.take_profile(logs)
    rows = d.forest_features(d.rule_features(logs, profiled, trailing.blocks(logs)).withColumn("burst_threshold", F.lit(5.0)), profiled).cache()
    hits = 0
    for seed in range(6):
        flagged = forest.with_outliers(rows, profiled.total, settings=forest.Settings(seed=seed))
        hits += not flagged.filter("is_outlier and id >= 113").isEmpty()
    rows.unpersist()
    assert hits >= 3


def test_ip_and_bot_signals(spark):
    rows = [log(i, after(minutes=10 * i), ip_address="1.1.1.1", message=f"x | Location: {c}") for i, c in enumerate(["USA", "usa", "India", "USA"])]
    rows += [log(10 + i, after(minutes=10 * i), ip_address=ip, status_code=404, message="y") for i, ip in enumerate(["2.2.2.2"] * 3 + [None] * 3 + [""] * 3)]
    rows += [log(30, source="web-BOT", event_type="DELETE", status_code=404, message="z"), log(31, event_type="PUT", message="Agent: Bot | Location: north korea")]
    found = defaultdict(set)
    for r in d.signals(frame(spark, rows), use_forest=False).collect():
        found[r.code].add(r.id)
    assert found["GEO_SPOOFING_IP"] == {0, 1, 2, 3}
    assert found["REPEATED_404"] == {10, 11, 12}
    assert found["MALICIOUS_BOT_ACTION"] == {30, 31}


def test_locations(spark):
    cases = [("a", "x | location:  Peru | y", "Peru"), ("web-brazil", "none", "brazil"), ("web-mars", "none", None), ("web-usa", "Location: | x", "usa"), ("s", None, None)]
    df = spark.createDataFrame(cases, "source string, message string, expected string")
    for r in df.select("expected", profile.location_of(F.col("message"), F.col("source")).alias("found")).collect():
        assert r.found == r.expected


def brute_counts(rows):
    seen, counts = defaultdict(list), {}
    for i, at, source in sorted(rows, key=lambda r: (r[1], r[0])):
        seen[source].append(at)
        counts[i] = sum(1 for t in seen[source] if t >= at - timedelta(seconds=300))
    return counts


@pytest.mark.parametrize("bits", [20, 3])
def test_trailing_counts_equal_brute_force(spark, monkeypatch, bits):
    """Ties, microseconds, window edges and a third of all rows with one source and time."""
    monkeypatch.setattr(trailing, "BLOCK_BITS", bits)
    pick = random.Random(bits)
    rows = []
    for i in range(1500):
        offset = pick.choice([pick.randrange(900_000_000), pick.randrange(900) * 1_000_000, 5_000_000, 305_000_000, 305_000_001])
        rows.append((i, datetime(2024, 1, 1) + timedelta(microseconds=offset), pick.choice("ab")) if i % 3 else (i, BASE, "hot"))
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, source string")
    expected = brute_counts(rows)
    found = trailing.with_trailing_count(df, trailing.blocks(df))
    assert {r.id: r.n_5m for r in found.collect()} == expected


def test_burst_threshold_equals_interpolated_percentile(spark):
    for values in ([3] * 9, list(range(1, 41)), [1, 2, 70_000, 140_000, 5, 6, 7, 8, 9, 200_000, 3, 3]):
        histogram = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").count().withColumnRenamed("count", "n")
        found = trailing.quantile(histogram, 0.95, 1 << 10).first()
        assert found.n == len(values)
        assert found.value == pytest.approx(float(np.percentile(values, 95)))
    few = frame(spark, [log(i) for i in range(9)])
    assert trailing.burst_threshold(trailing.histogram(trailing.blocks(few))).first().threshold == 5.0


def test_lookup_beyond_the_broadcast_limit(spark, monkeypatch):
    """Frequent, other, unknown and null keys all get the right values."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    keys = ["hot"] * 400 + [f"k{i % 50}" for i in range(500)] + [None] * 300 + ["unknown"] * 10
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    table = spark.createDataFrame([("hot", 400, 1)] + [(f"k{i}", 10, i + 2) for i in range(50)], "key string, n long, value long")
    found = {r.id: r.value for r in skew.lookup(rows, table, "key", "id", 51, len(keys)).collect()}
    expected = {"hot": 1, None: None, "unknown": None, **{f"k{i}": i + 2 for i in range(50)}}
    assert found == {i: expected[k] for i, k in enumerate(keys)}


def test_detection_is_the_same_beyond_the_broadcast_limit(spark, small, monkeypatch):
    from logloom.sources.tables import logs as read

    logs = read(spark, small)
    near = {r.id: r.anomaly_reason for r in d.detect(logs, use_forest=False).collect()}
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 3)
    assert {r.id: r.anomaly_reason for r in d.detect(logs, use_forest=False).collect()} == near


def test_rare_limits(spark):
    assert profile.rare_limit(179, schema.RARE_LOCATION_SHARE) == 1
    assert profile.rare_limit(1000, schema.RARE_LOCATION_SHARE) == 5


def feature_rows(spark, n, seed=1):
    pick = np.random.default_rng(seed)
    rows = [(i, *[float(x) for x in pick.integers(0, 50, 7)]) for i in range(n)]
    rows[-1] = (n - 1, *[5000.0] * 7)
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in forest.FEATURES))


def test_forest_finds_a_planted_outlier_and_keeps_to_its_share(spark):
    rows = feature_rows(spark, 600).cache()
    for seed in (42, 7):
        flags = forest.with_outliers(rows, 600, settings=forest.Settings(seed=seed)).filter("is_outlier").select("id").collect()
        assert 599 in {r.id for r in flags} and len(flags) <= 30


def test_forest_does_not_depend_on_partitions(spark):
    rows = feature_rows(spark, 300)
    settings = forest.Settings(trees=10)
    one = forest.with_outliers(rows.repartition(1), 300, settings=settings).filter("is_outlier").select("id")
    many = forest.with_outliers(rows.repartition(7), 300, settings=settings).filter("is_outlier").select("id")
    assert {r.id for r in one.collect()} == {r.id for r in many.collect()}


def test_forest_edge_cases(spark):
    assert forest.with_outliers(feature_rows(spark, 9), 9).filter("is_outlier").isEmpty()
    same = spark.createDataFrame([(i, *[1.0] * 7) for i in range(40)], "id long, " + ", ".join(f"{c} double" for c in forest.FEATURES))
    assert forest.with_outliers(same, 40, settings=forest.Settings(trees=5)).filter("is_outlier").isEmpty()


def test_forest_samples(spark):
    rows = feature_rows(spark, 5000)
    small = forest.draw(rows, 5000, forest.Settings(trees=20, sample=64)).groupBy("tree").agg(
        F.count("id").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert len(small) == 20 and all(r.n == 64 == r.ids for r in small)
    large = forest.draw(rows, 5000, forest.Settings(trees=2, sample=64)).groupBy("tree").count().collect()
    assert len(large) == 2 and all(r["count"] == 64 for r in large)


def test_a_forest_that_is_only_learned_stores_no_rows(spark, monkeypatch):
    rows, stored, staged = feature_rows(spark, 700), [], forest.staged
    settings = forest.Settings(trees=10)
    want, scored = forest.fit(rows, 700, settings=settings)
    monkeypatch.setattr(forest, "staged", lambda df: (stored.append(df.columns), staged(df))[1])
    got = forest.learn(rows, 700, settings=settings)
    assert (got.limit, got.sample) == (want.limit, want.sample) and stored == [want.nodes.columns]
    nodes, trees = want.nodes.orderBy("tree", "node").collect(), {}
    for r in nodes:
        trees.setdefault(r.tree, []).append(r)
    for row in scored.orderBy("id").limit(60).collect():  # the paths walked one by one
        paths = []
        for tree in trees.values():
            at = tree[0]
            while at.feature >= 0:
                at = tree[at.below if row[forest.FEATURES[at.feature]] <= at.cut else at.above]
            paths.append(at.depth + float(forest._mean_path(at.size)))
        assert row._score == pytest.approx(forest.SCALE * 2 ** (-np.mean(paths) / float(forest._mean_path(want.sample))), abs=1)

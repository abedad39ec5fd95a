from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import BASE, after, frame, log
from logloom.operators import explain as e
from logloom.operators import neighbours, tables
from logloom.plans import sync
from logloom.plans.detect import detect, detect_table
from logloom.session import shared_folder, staged
from logloom.sources.tables import logs as read_logs
from logloom.streaming import live


def now():
    return F.lit(datetime(2026, 9, 1)).cast("timestamp_ntz")


# --- Explanations

def one_anomaly(spark):
    row = log(3, source="door", event_type="KEY_TURNED", severity="WARNING", status_code=401, ip_address="172.16.7.7", message="the wrong key")
    return frame(spark, [row, log(4, after(9), source="other")]).withColumns({
        "anomaly": F.col("id") == 3, "anomaly_score": F.lit(75.0), "anomaly_reason": F.lit("many wrong keys"),
    })


def test_prompt(spark):
    rows = one_anomaly(spark)
    found = e.prompts(rows).collect()
    assert [r.id for r in found] == [3]
    assert "- IP Address: 172.16.7.7" in found[0].prompt and "75.0/100" in found[0].prompt
    assert "Do NOT evaluate whether this log is anomalous" in found[0].prompt and e.NO_CONTEXT in found[0].prompt
    peers = rows.unionByName(rows.filter("id = 3").withColumns({"id": F.lit(9).cast("long"), "anomaly": F.lit(False), "status_code": F.lit(None).cast("int")}))
    told = e.prompts(peers, neighbours.neighbours(peers, peers.filter("anomaly"))).first().prompt
    assert "- [PREVIOUS] Time: 2026-08-26 10:00:00 | Source: door | Severity: WARNING | Status: None | Message: the wrong key" in told


REPLIES = [
    ('```json\n{"explanation": "a fenced reply", "likely_root_cause": "cut wire", "recommended_next_step": "mend it"}\n```', ("a fenced reply", "cut wire", "mend it")),
    ('{\n  "explanation": "one comma more",\n  "likely_root_cause": "slow disk",\n  "recommended_next_step": "wait",\n}', ("one comma more", "slow disk", "wait")),
    ('Sure: {"explanation": "", "root_cause": "rc", "next_step": 0} ok', ("Anomalous event pattern detected.", "rc", "Inspect surrounding logs and verify service status.")),
    ('{"explanation": "a \\"b\\" c", "root_cause": "abc', ('a "b" c', "High-severity HTTP status or unusual request frequency.", "Inspect service logs, verify downstream APIs, and monitor traffic patterns.")),
    ("Something failed badly today.\nRoot Cause: pool exhausted\nNext Step: grow pool", ("Something failed badly today.\nRoot Cause: pool exhausted\nNext Step: grow pool", "pool exhausted", "grow pool")),
    ("short", ("Anomalous event pattern detected requiring review.", "High-severity HTTP status or unusual request frequency.", "Inspect service logs, verify downstream APIs, and monitor traffic patterns.")),
    ("", ("Anomalous event pattern detected requiring investigation.", "System anomaly or threshold deviation.", "Check application error logs and verify service dependencies.")),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)] + [(99, None)], "id int, reply string")
    found = {r.id: (r.explanation, r.likely_root_cause, r.recommended_next_step) for r in e.parse_reply(df).collect()}
    assert found == {**{i: parts for i, (_, parts) in enumerate(REPLIES)}, 99: REPLIES[-1][1]}


def test_only_anomalies_get_explanations(spark):
    rows = one_anomaly(spark)
    answers = e.explain(e.prompts(rows), lambda batch: pd.Series(['{"explanation": "why"}'] * len(batch)), "m1")
    assert answers.count() == 1
    stray = answers.unionByName(answers.withColumn("id", F.lit(4).cast("long")))
    found = {r.id: r for r in e.attach(rows, stray, now()).collect()}
    assert (found[3].ai_explanation, found[3].ai_model, found[3].ai_analyzed_at) == ("why", "m1", datetime(2026, 9, 1))
    assert found[3].ai_root_cause == "System error or threshold deviation."
    assert found[4].ai_explanation is None


# --- Tables

def test_upsert_keeps_the_newest_and_adds_columns(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    incoming = spark.createDataFrame([(2, "c", 1), (2, "d", 5), (3, "e", 1)], "id int, v string, at int")
    found = tables.upsert(current, incoming, order=F.col("at"))
    assert sorted((r.id, r.v, r.at) for r in found.collect()) == [(1, "a", None), (2, "d", 5), (3, "e", 1)]


def test_stored_upsert_and_delete_touch_only_their_days(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_logs(frame(spark, [log(i, after(days=i)) for i in range(4)]), path)
    untouched = {p.name for p in (tmp_path / "t" / "dt=2026-08-26").iterdir()}
    change = tables.with_day(frame(spark, [log(3, after(days=2), message="moved"), log(7, after(days=9))]))
    for _ in range(2):
        tables.upsert_table(spark, path, change)
    rows = {r.id: (r.message, str(r.dt)) for r in spark.read.parquet(path).collect()}
    assert rows[3] == ("moved", "2026-08-28") and rows[7][1] == "2026-09-04" and len(rows) == 5
    assert {p.name for p in (tmp_path / "t" / "dt=2026-08-26").iterdir()} == untouched
    gone = spark.createDataFrame([(1,), (3,), (55,)], "id long")
    assert tables.delete_from_table(spark, path, gone) == 2
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 7]
    assert tables.delete_from_table(spark, path, gone) == 0
    assert tables.clear_table(spark, path) == 3
    assert spark.read.parquet(path).count() == 0


def test_cascade(spark):
    logs = spark.createDataFrame([("l1",), ("l2",)], "id string")
    anomalies = spark.createDataFrame([("a1", "l1"), ("a2", "l1"), ("a3", "l2")], "id string, log_id string")
    texts = spark.createDataFrame([("t1", "a1"), ("t2", "a2"), ("t3", "a3")], "id string, anomaly_id string")
    left = tables.cascade(logs, anomalies, texts, logs.filter("id = 'l1'"))
    assert [[r.id for r in part.collect()] for part in left] == [["l2"], ["a3"], ["t3"]]


def test_first_existing_table(spark):
    assert tables.first_existing(spark, ("no_such_a", "no_such_b")) == "logs"


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert staged(spark.range(5)).count() == 5


def test_detect_table(spark, tmp_path):
    tables.append_logs(frame(spark, [log(1, message="Location: Cuba"), log(2, after(5))]), str(tmp_path / "in"))
    row = detect_table(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    assert (row.total_logs, row.anomalies) == (2, 1)


# --- Targets

def test_sync_is_idempotent_and_explains_all_anomalies(spark, tmp_path):
    rows = one_anomaly(spark)
    payload = sync.sync_all(rows, now())
    for _ in range(2):
        sync.write(spark, payload, str(tmp_path / "root"))
    assert [sync.target(spark, str(tmp_path / "root"), t).count() for t in sync.TARGETS] == [2, 1, 1]
    assert sync.counts(sync.sync_one(rows, 3, now())).first() == (1, 1, 0)
    assert sync.counts(sync.sync_one(rows, 4, now())).first() == (1, 0, 0)
    assert sync.counts(sync.feed_explanations(rows, now())).first() == (0, 1, 1)
    report = sync.cleaning_report(rows, now()).first()
    assert (report.total_input, report.timestamps_normalized, report.status_codes_normalized) == (2, 2, 2)


def test_seed(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "timestamp,source,event_type,severity,message\n2026-08-26 10:00:00,a,GET,INFO,Location: Iran\n2026-08-26 10:00:01,a,GET,INFO,ok\n,a,GET,INFO,bad\n"
    )

    def explain(scored, sample):
        texts = sample.select("id", F.lit('{"explanation": "why"}').alias("reply"), F.lit("m").alias("ai_model"))
        return e.attach(scored, texts, now())

    row = sync.seed(spark, str(tmp_path / "in.csv"), str(tmp_path / "root"), now(), explain=explain).first()
    assert row.asDict() == {
        "total_logs": 3, "valid_logs": 2, "rejected_logs": 1, "logs_synced": 2, "anomalies_synced": 1, "ai_synced": 1,
    }


# --- Streams

@pytest.fixture(scope="module")
def arriving(spark, small, tmp_path_factory):
    """The small table as four files in time order."""
    folder = str(tmp_path_factory.mktemp("arriving") / "in")
    rows = read_logs(spark, small)
    cuts = rows.approxQuantile("id", [0.25, 0.5, 0.75], 0.0)
    for low, high in zip([-1, *cuts], [*cuts, 1e9]):
        rows.filter((F.col("id") > low) & (F.col("id") <= high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_batches_score_as_the_whole_table(spark, small, arriving, tmp_path):
    whole = read_logs(spark, small)
    live.save_statistics(whole, str(tmp_path / "stats"))
    table = str(tmp_path / "table")
    stream = live.read_logs(spark, arriving, files_per_batch=1)
    sink = live.scoring_sink(table, str(tmp_path / "stats"))
    live.start(stream, sink, str(tmp_path / "marks")).awaitTermination()
    expected = {r.id: r.anomaly_reason for r in detect(whole).collect()}
    found = spark.read.parquet(table)
    assert found.select("batch").distinct().count() == 4
    assert {r.id: r.anomaly_reason for r in found.collect()} == expected
    # a batch that is handled again leaves the table as it is
    last = spark.read.parquet(arriving).filter(F.col("id").isin([r.id for r in found.filter("batch = 3").collect()]))
    sink(last, 3)
    again = spark.read.parquet(table)
    assert {r.id: r.anomaly_reason for r in again.collect()} == expected and again.count() == len(expected)
    captured = live.capture_report(again, 3).first()
    assert captured.logs_captured == last.count()
    counters = live.running_counters(again).first()
    assert (counters.rows, counters.anomalies) == (len(expected), sum(r.startswith("Flagged") for r in expected.values()))


def test_full_rescoring(spark, arriving, tmp_path):
    table = str(tmp_path / "table")
    stream = live.read_logs(spark, arriving, files_per_batch=2)
    live.start(stream, live.scoring_sink(table, full=True), str(tmp_path / "marks")).awaitTermination()
    whole = detect(spark.read.parquet(arriving))
    assert {r.id: r.anomaly_score for r in spark.read.parquet(table).collect()} == {r.id: r.anomaly_score for r in whole.collect()}


def test_viewer(spark, arriving, tmp_path):
    stream = live.read_logs(spark, arriving, files_per_batch=1)
    live.start(stream, live.newest_sink(str(tmp_path / "view"), 50), str(tmp_path / "m1")).awaitTermination()
    newest = spark.read.parquet(arriving).orderBy(F.desc("timestamp"), F.desc("id")).limit(50)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "view")).collect()} == {r.id for r in newest.collect()}


def test_window_counts_stream_equals_batch(spark, arriving, tmp_path):
    out = str(tmp_path / "out")
    counts = live.window_counts(live.read_logs(spark, arriving, files_per_batch=1))
    writer = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "m"))
    writer.trigger(availableNow=True).start().awaitTermination()
    batch = {(r.window_start, r.source): (r.n, r.errors) for r in live.window_counts(spark.read.parquet(arriving)).collect()}
    found = {(r.window_start, r.source): (r.n, r.errors) for r in spark.read.parquet(out).collect()}
    assert len(found) > 0 and all(batch[k] == v for k, v in found.items())


def test_a_model_is_given_few_rows_at_once(spark):
    """A worker holds the texts of one small batch, whatever Spark's own batches are."""
    requests = spark.range(1000).coalesce(1).withColumn("prompt", F.concat(F.lit("p"), F.col("id").cast("string")))
    answers = e.explain(requests, lambda batch: batch["prompt"] + " " + str(len(batch)), "m").collect()
    assert sorted(r.id for r in answers) == list(range(1000)) and {r.ai_model for r in answers} == {"m"}
    assert all(r.reply.split()[0] == f"p{r.id}" for r in answers)
    assert max(int(r.reply.split()[1]) for r in answers) <= 256


def test_nearest_logs_are_laid_out_once(spark, capsys):
    """The times of a key are stored and not made anew for each of the steps that read them; ties at one time are kept apart."""
    rows = frame(spark, [log(k, after(k // 7), source=f"s{k % 2}", ip_address=f"ip{k % 3}", message=f"m{k}") for k in range(60)]).localCheckpoint()
    found = neighbours.neighbours(rows, rows.filter("id % 5 = 0"))
    found.explain()
    assert "row_number" not in capsys.readouterr().out
    logs = {r.id: r for r in rows.collect()}
    for got in found.collect():
        own = logs[got.id]
        near = [r for r in logs.values() if r.id != own.id and (r.source == own.source or r.ip_address == own.ip_address)]
        earlier = sorted((r.timestamp, r.id) for r in near if r.timestamp <= own.timestamp)[-3:]
        later = sorted((r.timestamp, r.id) for r in near if r.timestamp >= own.timestamp)[:3]
        assert [c.id for c in got.context] == [i for _, i in earlier] + [own.id] + [i for _, i in later]

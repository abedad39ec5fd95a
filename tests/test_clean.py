import json
import math
from datetime import datetime

from pyspark.sql import functions as F

from helpers import BASE, frame, log
from logloom.functions.clean import normalize_status, to_json
from logloom.operators import layouts as y
from logloom.sources.event_text import as_logs, parse_event_text, read_event_text


def now():
    return F.lit(datetime(2026, 9, 1)).cast("timestamp_ntz")


def test_json_values(spark):
    row = (float("nan"), float("inf"), 17.123456789, 100, datetime(2026, 8, 27, 10, 30), "left\x00right\x1f?\n ", [1.0, float("nan")], {"inner": -math.inf}, None)
    kind = "a double, b double, c double, d int, e timestamp_ntz, f string, g array<double>, h map<string,double>, i struct<x:string>"
    found = json.loads(to_json(spark.createDataFrame([row], kind)).first().json)
    assert found == {
        "a": None, "b": None, "c": 17.123457, "d": 100, "e": "2026-08-27T10:30:00", "f": "leftright?", "g": [1.0, None], "h": {"inner": None}, "i": None,
    }


def test_status_codes(spark):
    cases = {"500": 500, "HTTP 404 Not Found": 404, "nan": None, "invalid": None, "999": None, "200.0": 200, "-": None, "1200": None, "99": None, "a 201 b 404": 201, "5e2": 500}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.n for r in df.select("s", normalize_status(F.col("s")).alias("n")).collect()} == cases
    numbers = spark.createDataFrame([(200.9,), (float("nan"),), (99.0,), (None,)], "s double")
    assert [r.n for r in numbers.select(normalize_status(F.col("s"), "double").alias("n")).collect()] == [200, None, None, None]


def test_access_layout(spark):
    record = [("2025-03-02 12:00:00", "172.16.0.3", "lent", "204", "web-reader", "/session/41", "Norway")]
    df = spark.createDataFrame(record, "timestamp string, ip_address string, event_type string, status_code string, source string, endpoint string, location string")
    row = y.clean_records(df, now()).first().asDict()
    assert len(row.pop("id")) == 36
    assert row == {
        "timestamp": "2025-03-02T12:00:00Z", "ip_address": "172.16.0.3", "event_type": "LENT", "status_code": 204,
        "user_agent": "Web-reader", "session_id": "41", "location": "Norway",
    }


def test_defaults_of_the_log_layout(spark):
    df = spark.createDataFrame([("", None, "", "404", ""), ("x", "none", "get ", "", "INTERNET Explorer")], "timestamp string, ip string, event string, status string, User_Agent string")
    rows = y.clean_records(df, now(), y.LOGS).drop("id").collect()
    assert rows[0].asDict() == {
        "timestamp": "2026-09-01T00:00:00Z", "source": "api-service", "event_type": "SYSTEM_EVENT", "severity": "WARNING",
        "status_code": 404, "ip_address": "127.0.0.1", "message": "Event SYSTEM_EVENT on api-service",
    }
    assert (rows[1].timestamp, rows[1].event_type, rows[1].severity) == ("x", "GET", "INFO")
    agent = y.clean_records(df, now(), y.ACCESS).collect()
    assert (agent[1].user_agent, agent[1].session_id, agent[1].location) == ("Internet explorer", "1000", "Global")


def test_names_are_stable(spark):
    rows = y.stored(frame(spark, [log(1), log(2)]))
    first, again = [r.uuid for r in rows.collect()], [r.uuid for r in rows.repartition(3).orderBy("id").collect()]
    assert first == again and len(set(first)) == 2


def scored(spark):
    row = log(1, datetime(2026, 8, 26, 10), "desk", "FINE_DUE", "ERROR", "172.16.0.4", 500, None, "the till is shut")
    extra = {"anomaly": F.lit(True), "anomaly_score": F.lit(85.0), "anomaly_reason": F.lit("shut twice")}
    return frame(spark, [row]).withColumns(extra)


def test_cloud_records(spark):
    told = scored(spark).withColumns({"ai_explanation": F.lit(" No key. "), "ai_root_cause": F.lit("Lost.")})
    one = y.cloud_logs(told, now()).first()
    assert (one.timestamp, one.created_at, one.status_code) == ("2026-08-26T10:00:00", "2026-09-01T00:00:00", 500)
    anomaly = y.cloud_anomalies(told, now()).first()
    assert (anomaly.is_anomaly, anomaly.anomaly_score, anomaly.log_id) == (True, 85.0, one.id)
    assert y.cloud_anomalies(told, now(), narrow=True).columns == ["id", "log_id", "is_anomaly", "is_anamoly"]
    ai = y.cloud_explanations(told, now()).first()
    assert (ai.anomaly_id, ai.explanation, ai.root_cause) == (anomaly.id, "No key.", "Lost.")
    bare = y.cloud_explanations(scored(spark), now()).first()
    assert bare.explanation == "shut twice"
    assert bare.root_cause == "Abnormal behavioral signature detected on FINE_DUE."
    nothing = y.cloud_explanations(frame(spark, [log(1)]), now()).first()
    assert nothing.explanation == "Suspicious HTTP_REQUEST event flagged with severity INFO."


def test_display_record(spark):
    row = y.records(scored(spark).withColumn("anomaly_score", F.lit(12.25))).first()
    assert (row.timestamp, row.anomaly_score, row.has_ai_analysis, row.created_at) == ("2026-08-26 10:00:00", 12.2, False, None)


def test_cleaning_in_place(spark):
    row = y.clean_in_place(frame(spark, [log(1, event_type=" get\x07", status_code=999, ip_address="N/A")])).first()
    assert (row.event_type, row.status_code, row.ip_address) == ("GET", 999, "127.0.0.1")


def test_export(spark, tmp_path):
    rows = scored(spark).unionByName(scored(spark).withColumns({"id": F.lit(2).cast("long"), "status_code": F.lit(None).cast("int"), "message": F.lit('a "b"\nc'), "timestamp": F.lit("2026-08-27 00:00:00").cast("timestamp_ntz")}))
    y.export_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert back.columns == list(y.EXPORT)
    found = {r.ID: r for r in back.collect()}
    assert found["2"].Message == 'a "b"\nc' and found["2"]["Status Code"] is None and found["1"]["Anomaly Score"] == "85.0"
    assert [r.ID for r in y.export_rows(rows).collect()] == ["2", "1"]


DUMP = """
Event[17]
  Level: Warning
  Computer: mill-2
  Event ID: 00912
  Date: 2025-02-03T06:07:08.5000000Z
  Source: Water Wheel
  Description: belt\x07 three   slipped
twice before noon

Event[18]
  Source:
  Level: Critical
  Description: """ + "long " * 100 + """

 Event[19]
  nothing
"""


def test_event_text(spark, tmp_path):
    (tmp_path / "dump.txt").write_text(DUMP)
    rows = parse_event_text(read_event_text(spark, str(tmp_path / "dump.txt")), now()).orderBy("row_no").drop("row_no").collect()
    assert len(rows) == 3
    assert rows[0].asDict() == {
        "timestamp": "2025-02-03T06:07:08Z", "source": "Water Wheel", "event_type": "WIN_APPLICATION", "severity": "WARNING", "status_code": 403,
        "ip_address": "127.0.0.1", "endpoint": "/system/application/912", "message": "belt three slipped twice before noon",
    }
    assert (rows[1].severity, rows[1].status_code) == ("CRITICAL", 503)
    assert len(rows[1].message) == 303 and rows[1].timestamp == "2026-09-01T00:00:00Z"
    assert (rows[2].message, rows[2].endpoint, rows[2].source) == ("Windows Event Log Entry", "/system/application/100", "Windows-Application")
    logs = as_logs(parse_event_text(read_event_text(spark, str(tmp_path / "dump.txt")), now()), now())
    assert logs.orderBy("row_no").first().timestamp == datetime(2025, 2, 3, 6, 7, 8)

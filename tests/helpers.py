"""Log rows for tests."""

from datetime import datetime, timedelta

from logloom import schema

BASE = datetime(2026, 8, 26, 10, 0, 0)
FIELDS = schema.LOG.fieldNames()


def log(id, at=BASE, source="api-01", event_type="HTTP_REQUEST", severity="INFO", ip_address=None, status_code=200, endpoint=None, message="m"):
    return (id, at, source, event_type, severity, ip_address, status_code, endpoint, message)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.LOG)


def after(seconds=0, **more):
    return BASE + timedelta(seconds=seconds, **more)

"""Scoring and watching logs as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from logloom import schema
from logloom.operators import forest
from logloom.operators.profile import Profile, load_profile, notable_ips, take_profile, with_location
from logloom.operators.signals import with_score
from logloom.operators.skew import lookup
from logloom.operators.tables import DAY, table_exists, with_day
from logloom.operators.trailing import blocks, burst_threshold, histogram, with_trailing_count
from logloom.plans.detect import detect, forest_features, rule_features
from logloom.plans.sync import sync_all, write
from logloom.session import prepare, ship, staged
from logloom.sources import ranges
from logloom.sources.event_text import as_logs, event_records, parse_event_text


def read_logs(spark: SparkSession, path: str, kind: T.StructType = schema.LOG, files_per_batch: int | None = None) -> DataFrame:
    """Log files as a stream."""
    reader = prepare(spark).readStream.schema(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``handle`` on each batch; without ``every`` process what is there and stop."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- Event-time transformations, the same on streams and tables


def viewer_dedup(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each id once, remembered for as long as late rows are accepted."""
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def window_counts(logs: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Logs and errors per source and sliding window.

    On a stream in append mode a window is emitted once the watermark passed its
    end. Counts are partial before the shuffle, so a busy source sends a row per
    task and window.
    """
    timed = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    marked = timed.withWatermark("timestamp", delay) if logs.isStreaming else timed
    return (
        marked.groupBy(F.window("timestamp", length, slide).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).alias("errors"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "source", "n", "errors")
    )


def running_counters(scored: DataFrame) -> DataFrame:
    """Rows and anomalies so far; use output mode ``complete``."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("anomaly")).alias("anomalies"))


# --- Trailing counts with state

_MICROS = 1_000_000
_STATE = "times array<long>, ids array<long>, before array<long>"


def _close(times: list[int], ids: list[int], before: list[int], span: int) -> pd.DataFrame:
    """The trailing count of every row of a cell, given the times of the cell before it."""
    order = np.lexsort((ids, times))
    at, earlier = np.array(times, dtype=np.int64)[order], np.sort(np.array(before, dtype=np.int64))
    own = np.arange(1, len(at) + 1) - np.searchsorted(at, at - span, "left")
    return pd.DataFrame({"id": np.array(ids, dtype=np.int64)[order], "n_5m": own + len(earlier) - np.searchsorted(earlier, at - span, "left")})


def trailing_state(logs: DataFrame, delay: str = "10 minutes", seconds: int = schema.WINDOW_SECONDS) -> DataFrame:
    """``id`` and ``n_5m`` of a stream of logs: how many logs of the source came in the ``seconds`` up to it, itself included.

    The state is kept per source and cell of ``seconds``: the rows of the cell, and
    the times of the cell before, which no trailing window exceeds. A cell is
    counted, written and forgotten once the watermark has passed its end, so rows
    that come out of order within ``delay`` are counted as if they had come in order,
    as ``with_trailing_count`` counts them; ties go by id. Later rows are dropped,
    and rows without a time have no count. A source's rows are spread over
    its cells; state holds two cells and the delay of each source, never the table.
    """
    ship(logs.sparkSession)
    span = seconds * _MICROS
    timed = logs.select("id", "source", F.col("timestamp").cast("timestamp").alias("_time")).filter("_time is not null")
    marked = timed.withWatermark("_time", delay).withColumn("_micros", F.unix_micros("_time"))
    cell = F.call_function("div", F.col("_micros") - F.pmod("_micros", F.lit(span)), F.lit(span))
    placed = marked.withColumn("_role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_cell", cell + F.col("_role"))

    def count(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [list(part) for part in state.get] if state.exists else [[], [], []]
        end = (int(key[1]) + 1) * span
        if state.hasTimedOut:
            state.remove()
            if held[0]:
                yield _close(*held, span)
            return
        passed = state.getCurrentWatermarkMs() * 1000
        for part in rows:
            kept = part[(part["_micros"] // span + 1) * span > passed]
            own = kept[kept["_role"] == 0]
            held[0] += own["_micros"].tolist()
            held[1] += own["id"].tolist()
            held[2] += kept.loc[kept["_role"] == 1, "_micros"].tolist()
        if end > passed and any(held):
            state.update(tuple(held))
            state.setTimeoutTimestamp(end // 1000)

    kept = placed.select("id", "source", "_cell", "_micros", "_role", "_time").groupBy("source", "_cell")
    return kept.applyInPandasWithState(count, "id long, n_5m long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- Scoring batches


@dataclass(frozen=True)
class Statistics:
    """Whole-table statistics a batch is scored with."""

    profile: Profile
    burst_threshold: float
    forest: forest.Fitted | None


def take_statistics(logs: DataFrame, use_forest: bool = True) -> Statistics:
    """The statistics of a table; the forest, too, unless there are too few logs for one."""
    seen, counted = take_profile(logs), staged(blocks(logs))
    threshold = float(burst_threshold(histogram(counted)).first()["threshold"])
    if not use_forest or seen.total < forest.MIN_ROWS:
        return Statistics(seen, threshold, None)
    rows = staged(forest_features(rule_features(logs, seen, counted), seen).select("id", *forest.FEATURES))
    return Statistics(seen, threshold, forest.learn(rows, seen.total))


def save_statistics(logs: DataFrame, path: str, use_forest: bool = True) -> None:
    """Store the statistics of a table for later batches."""
    taken = take_statistics(logs, use_forest)
    taken.profile.table.write.mode("overwrite").parquet(f"{path}/profile")
    about = logs.sparkSession.createDataFrame([(taken.burst_threshold, taken.forest is not None)], "threshold double, forest boolean")
    if taken.forest is not None:
        forest.save(taken.forest, f"{path}/forest")
    about.write.mode("overwrite").parquet(f"{path}/burst")


def load_statistics(spark: SparkSession, path: str) -> Statistics:
    table, about = spark.read.parquet(f"{path}/profile"), spark.read.parquet(f"{path}/burst").first()
    return Statistics(load_profile(table), about["threshold"], forest.load(spark, f"{path}/forest") if about["forest"] else None)


def score_batch(batch: DataFrame, recent: DataFrame | None, saved: Statistics, threshold: int = schema.THRESHOLD) -> DataFrame:
    """Score new logs by saved statistics, the forest's included; the trailing counts are exact.

    ``recent`` are stored logs of the five minutes before the batch. The counts
    follow event time, so it does not matter in which order rows came.
    """
    columns = schema.LOG.fieldNames()
    new = batch.select(*columns).withColumn("_new", F.lit(True))
    rows = new if recent is None else new.unionByName(recent.select(*columns).withColumn("_new", F.lit(False)))
    counted = with_trailing_count(with_location(rows)).filter("_new").drop("_new")
    seen = saved.profile
    known = lookup(counted, notable_ips(seen.table), "ip_address", "id", seen.sizes.get("ip", 0), seen.total)
    ready = known.withColumn("burst_threshold", F.lit(saved.burst_threshold))
    if saved.forest is None:
        ready = ready.withColumn("is_outlier", F.lit(False))
    else:
        ready = forest.flagged(forest_features(ready, seen), saved.forest)
    return with_score(ready, seen, threshold).select(*columns, "anomaly", "anomaly_score", "anomaly_reason")


def recent_logs(spark: SparkSession, table: str, batch: DataFrame, batch_id: int) -> DataFrame | None:
    """Stored logs, other than this batch's, of the five minutes before it and its own time."""
    if not table_exists(spark, table):
        return None
    first, last = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = F.expr(f"INTERVAL {schema.WINDOW_SECONDS} SECONDS")
    begin, end = F.lit(first).cast("timestamp_ntz") - span, F.lit(last).cast("timestamp_ntz")
    stored = spark.read.parquet(table).filter(F.col("batch") != batch_id)
    return stored.filter(
        (F.col(DAY) >= F.to_date(begin)) & (F.col(DAY) <= F.to_date(end))
        & (F.col("timestamp") >= begin) & (F.col("timestamp") <= end)
    )


def scoring_sink(
    table: str, statistics: str | None = None, threshold: int = schema.THRESHOLD, full: bool = False, targets: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch handler that scores and stores logs by day and batch.

    Writing a batch again replaces exactly its own files, so a retry after a
    failure leaves no duplicates. Without saved ``statistics`` the first batch
    is compared with itself. ``full`` rescores the whole table instead, at a cost
    that grows with it. ``targets`` also upserts the three target tables.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch)
        if rows.isEmpty():
            return
        earlier = None
        if full:
            if table_exists(spark, table):
                old = spark.read.parquet(table).filter(F.col("batch") != batch_id)
                earlier = staged(old)
                rows = rows.withColumn("batch", F.lit(batch_id).cast("int"))
                columns = [*schema.LOG.fieldNames(), "batch"]
                scored = detect(earlier.select(*columns).unionByName(rows.select(*columns)), threshold)
            else:
                scored = detect(rows, threshold).withColumn("batch", F.lit(batch_id).cast("int"))
        else:
            saved = load_statistics(spark, statistics) if statistics and table_exists(spark, statistics) else take_statistics(rows)
            recent = recent_logs(spark, table, rows, batch_id)
            scored = score_batch(rows, recent, saved, threshold).withColumn("batch", F.lit(batch_id).cast("int"))
        ready = staged(with_day(scored))
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch").parquet(table)
        if targets:
            own = ready.filter(F.col("batch") == batch_id)
            # the batch's last time, so that a retry writes the same records
            now = F.lit(own.agg(F.max("timestamp")).first()[0]).cast("timestamp_ntz")
            write(spark, sync_all(own, now), targets, moves=False)  # a log's time, and so its day, is fixed

    return handle


# --- From captured text to scored logs

#: A batch's ids begin at its number times this.
BATCH_IDS = 1 << 32


def read_capture(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Captured event dumps as a stream of lines that know their file and split."""
    reader = prepare(spark).readStream
    lines = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(path)
    return ranges.lines_of(lines).withColumn("_seen", F.col("_metadata.file_modification_time"))


def captured_logs(lines: DataFrame, batch_id: int, captured_at: Column | None = None, **parse) -> DataFrame:
    """The log records of a batch of captured lines.

    An id is the batch's number and the record's place among the batch's files, so
    a batch that is taken again gives the same ids. Every record is valid: fields
    that the text lacks get their defaults. A missing date is that of the capture,
    by default the latest time a file of the batch was written.
    """
    now = captured_at
    if now is None:
        now = F.lit(lines.agg(F.max("_seen").cast("timestamp_ntz")).first()[0]).cast("timestamp_ntz")
    events = as_logs(parse_event_text(event_records(lines.select("_file", "_block", "value")), now, **parse), now)
    return events.withColumn("id", F.lit(batch_id).cast("long") * BATCH_IDS + F.col("row_no")).select(*schema.LOG.fieldNames())


def capture_sink(
    table: str, statistics: str | None = None, captured_at: Column | None = None, threshold: int = schema.THRESHOLD,
    full: bool = False, targets: str | None = None, **parse,
) -> Callable[[DataFrame, int], None]:
    """A batch handler from captured text to stored, scored logs; see ``captured_logs`` and ``scoring_sink``."""
    score = scoring_sink(table, statistics, threshold, full, targets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            score(captured_logs(batch, batch_id, captured_at, **parse), batch_id)

    return handle


def newest_sink(path: str, keep: int = 200) -> Callable[[DataFrame, int], None]:
    """A batch handler that holds the newest logs for a viewer, each id once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(keep)
        if table_exists(spark, path):
            rows = rows.unionByName(spark.read.parquet(path)).dropDuplicates(["id"])
            rows = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(keep)
        staged(rows).coalesce(1).write.mode("overwrite").parquet(path)

    return handle


def capture_report(table: DataFrame, batch_id: int) -> DataFrame:
    """One row: logs captured and anomalies found in a batch."""
    return table.filter(F.col("batch") == batch_id).agg(
        F.count(F.lit(1)).alias("logs_captured"), F.count_if(F.col("anomaly")).alias("anomalies_detected")
    )

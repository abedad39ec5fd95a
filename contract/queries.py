"""The registered queries: each reads whole tables of ``folder`` and returns one frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.clean import normalize_ip, normalize_status, sanitize
from logloom.functions.times import normalize_time, parse_time
from logloom.operators import explain, explorer, forest, layouts, neighbours, rollups, stats, tables, trailing, validate
from logloom.operators import profile as profiles
from logloom.operators.published import Store
from logloom.plans import detect as detection
from logloom.plans import ingest, sync
from logloom.session import shared_folder, staged
from logloom.sources import tables as views
from logloom.sources.event_text import parse_event_text, read_event_text
from logloom.sources.ranges import lines_of
from logloom.streaming import live

RECORD = ["id", "timestamp", "source", "event_type", "severity", "ip_address", "status_code", "endpoint", "message"]
VALID = ["row_no", *RECORD[1:], "is_duplicate"]


def _now():
    """The job time of all queries."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def _folder(spark: SparkSession) -> str:
    """A new folder for what a query writes."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Logs scored by the rules alone, which a SQL engine can check."""
    return detection.detect(views.logs(spark, folder), use_forest=False)


def explained(spark: SparkSession, folder: str) -> DataFrame:
    """Scored logs, of which every third anomaly has an explanation."""
    has = F.col("anomaly") & (F.col("id") % 3 == 0)
    return scored(spark, folder).withColumns({
        "ai_explanation": F.when(has, F.concat(F.lit(" why "), "event_type")),
        "ai_root_cause": F.when(has & (F.col("id") % 2 == 0), F.concat(F.lit("cause "), "source")),
        "ai_next_step": F.lit(None).cast("string"),
        "ai_model": F.when(has, F.lit("model-a")),
        "uuid": F.concat(F.lit("log-000000-"), F.col("id").cast("string")),
    })


# --- Explorer

def q_search(spark, folder):
    return explorer.search(views.logs(spark, folder), "LOCATION: g_rm")


def q_filters(spark, folder):
    return explorer.find(views.logs(spark, folder), "api/v1", "error", "svc-3", False, "2024-01-01", "2024-01-01")


def q_date_range(spark, folder):
    return explorer.date_range(views.logs(spark, folder), "2024-01-01", "2024-01-01").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )


def q_anomalies_only(spark, folder):
    return explorer.anomalies_only(scored(spark, folder), "yes").select("id", "anomaly_score")


def q_page(spark, folder):
    return explorer.page(views.logs(spark, folder), 3, 25, "status_code", "asc")


def q_page_after(spark, folder):
    from datetime import datetime

    return explorer.page_after(views.logs(spark, folder), datetime(2024, 1, 1, 6), 100, 25)


def q_page_info(spark, folder):
    return explorer.page_info(explorer.equals(views.logs(spark, folder), "critical"), 3, 25)


def q_point(spark, folder):
    return explorer.by_id(views.logs(spark, folder), 77)


def q_by_ids(spark, folder):
    logs = views.logs(spark, folder)
    return explorer.by_ids(logs, logs.filter(F.col("id") % 13 == 0).select("id"))


def q_recent(spark, folder):
    return explorer.recent_anomalies(scored(spark, folder)).select(*RECORD, "anomaly_score", "anomaly_reason")


def q_sources(spark, folder):
    return explorer.sources(views.logs(spark, folder))


def q_ai_sample(spark, folder):
    return explorer.first_anomalies(scored(spark, folder)).select("id", "timestamp")


# --- Dashboard

def k_totals(spark, folder):
    return stats.totals(explained(spark, folder))


def k_severity(spark, folder):
    return stats.severity_distribution(views.logs(spark, folder))


def k_by_source(spark, folder):
    return stats.anomalies_by_source(scored(spark, folder))


def k_timeline(spark, folder):
    return stats.timeline(scored(spark, folder))


def k_timeline_sampled(spark, folder):
    return stats.timeline_sampled(scored(spark, folder))


def k_bands(spark, folder):
    return stats.score_bands(scored(spark, folder)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def k_rolled_up(spark, folder):
    """The dashboard from the sums of a published table, after rows were changed, moved to another day, and deleted."""
    rows, store = staged(explained(spark, folder)), rollups.store(spark, _folder(spark))
    store.upsert({"logs": tables.with_day(rows.filter(F.col("id") % 5 != 0))})
    moved = rows.filter(F.col("id") % 10 < 2).withColumns({"timestamp": F.col("timestamp") + F.expr("INTERVAL 1 DAY"), "source": F.lit("moved")})
    store.upsert({"logs": tables.with_day(moved)})
    store.delete("logs", rows.filter(F.col("id") % 7 == 0).select("id"))
    sums = store.rollup("logs")
    line = lambda part, key, n, m: [F.lit(part).alias("part"), F.col(key).alias("name"), F.col(n).alias("n"), m.cast("long").alias("m")]
    none = F.lit(None)
    totals = rollups.totals(sums).withColumn("name", F.lit("all"))
    return (
        rollups.timeline(sums).select(line("minute", "bucket", "total", F.col("anomalies")))
        .unionByName(rollups.anomalies_by_source(sums).select(line("source", "source", "n", none)))
        .unionByName(rollups.severity_distribution(sums).select(line("severity", "severity", "n", none)))
        .unionByName(totals.select(line("logs", "name", "total_logs", F.col("total_anomalies"))))
        .unionByName(totals.select(line("explained", "name", "ai_analyses_count", F.col("critical_anomalies"))))
        .unionByName(rollups.recent(store).select(F.lit("recent").alias("part"), "source", F.col("id").alias("n"), none.cast("long").alias("m")).withColumnRenamed("source", "name"))
    )


# --- Validation and import

def v_valid(spark, folder):
    return validate.validate(views.logs_raw(spark, folder)).valid.select(*VALID)


def v_errors(spark, folder):
    return validate.validate(views.logs_raw(spark, folder)).errors


def v_iso_forms(spark, folder):
    """Times of the logs written in twelve ways; the last two are not times."""
    time, form = F.col("timestamp"), F.col("id") % 12
    written = F.lit(None).cast("string")
    week = F.format_string("%04d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), time), F.weekofyear(time), F.weekday(time) + 1)
    forms = (
        F.date_format(time, "yyyyMMdd'T'HHmmss"), F.concat(week, F.date_format(time, "'T'HH:mm:ss")),
        F.date_format(time, "yyyy-MM-dd'_'HH:mm:ss"), F.date_format(time, "yyyy-MM-dd HH:mm:ss',500'"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'.123456789Z'"), F.date_format(time, "yyyy-MM-dd'T'HH:mm"), F.date_format(time, "yyyy-MM-dd'T'HH"),
        F.date_format(time, "yyyyMMdd'T'HHmmss'.25-0530'"), F.replace(week, F.lit("-"), F.lit("")), F.date_format(time, "yyyy-MM-dd HH:mm:ss' Europe/Paris'"),
        F.date_format(time, "yyyy'-W54-1'"),
    )
    for place, text in enumerate(forms):
        written = F.when(form == place, text).otherwise(written)
    logs = views.logs(spark, folder).withColumn("written", written)
    return logs.select("id", "written", parse_time(F.col("written")).alias("parsed"))


def v_error_head(spark, folder):
    return validate.error_head(validate.validate(views.logs_raw(spark, folder)).errors)


def v_summary(spark, folder):
    return validate.validate(views.logs_raw(spark, folder)).summary


def v_duplicates(spark, folder):
    return validate.validate(views.logs_raw(spark, folder)).valid.filter("is_duplicate").select("row_no")


def v_access(spark, folder):
    return validate.validate(views.access_raw(spark, folder)).valid.select(*VALID)


def v_import_report(spark, folder):
    return ingest.import_report(validate.validate(views.logs_raw(spark, folder)))


def s_csv_scan(spark, folder):
    """Line breaks and stray quotes inside cells, read in splits that cut through both."""
    path = _folder(spark)
    rows = views.logs_raw(spark, folder).withColumn("message", F.replace("message", F.lit(" | "), F.lit('\n"quoted", ')))
    rows.drop("row_no").write.option("header", True).option("escape", '"').csv(path)
    with _small_splits(spark, 1 << 20):
        return ingest.validate_file(spark, path).valid.select(*VALID[1:])


def s_csv_wide(spark, folder):
    """A header of 300 columns and more than 4,096 characters."""
    path, wide = _folder(spark), [f"extra_column_number_{i:04d}" for i in range(292)]
    rows = views.logs_raw(spark, folder).drop("row_no")
    rows.select(*[F.lit("x").alias(c) for c in wide], *rows.columns).write.option("header", True).option("escape", '"').csv(path)
    return ingest.validate_file(spark, path).valid.select(*VALID[1:-1])


def s_csv_mixed(spark, folder):
    """Files of two kinds: columns in another order, one kind without an endpoint, and another delimiter each."""
    path, rows = _folder(spark), views.logs_raw(spark, folder)
    names = [c for c in rows.columns if c != "row_no"]
    one, two = rows.filter(F.col("row_no") % 2 == 0).select(*names), rows.filter(F.col("row_no") % 2 == 1)
    for part, kept, sep in ((one, names, ";"), (two, [c for c in reversed(names) if c != "endpoint"], "\t")):
        part.select(*kept).write.mode("append").option("header", True).option("escape", '"').option("sep", sep).csv(path)
    return ingest.validate_file(spark, path).valid.select(*[c for c in VALID[1:-1] if c != "endpoint"])


def _csv_by(spark, folder, sep):
    path = _folder(spark)
    views.logs_raw(spark, folder).drop("row_no").withColumn("message", F.replace("message", F.lit("|"), F.lit("/"))).write.option("header", True).option("escape", '"').option("sep", sep).csv(path)
    return ingest.validate_file(spark, path).valid.select("timestamp", "source", "event_type", "severity", "status_code")


def s_csv_tab(spark, folder):
    return _csv_by(spark, folder, "\t")


def s_csv_pipe(spark, folder):
    return _csv_by(spark, folder, "|")


def s_empty_checks(spark, folder):
    """What files without rows or header report, beside how many events there are."""
    total = views.logs(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    found = None
    for name, line in (("nothing", ""), ("header", "timestamp,source,event_type,severity,message")):
        path = _folder(spark)
        total.select(F.lit(line).alias("value")).write.text(path)
        errors = ingest.validate_file(spark, path).errors.crossJoin(F.broadcast(total)).select(F.lit(name).alias("name"), "field", "message", "n")
        found = errors if found is None else found.unionByName(errors)
    return found


def s_append(spark, folder):
    path = _folder(spark)
    tables.append_logs(views.logs(spark, folder).filter(F.col("id") % 2 == 0), path)
    tables.append_logs(views.logs(spark, folder).filter(F.col("id") % 2 == 1), path)
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id")
    )


def s_export(spark, folder):
    return layouts.export_rows(explained(spark, folder))


def event_dumps(spark, folder, path):
    """Every log as two blocks of event text, in dumps of many logs, written as files."""
    level = F.when(F.col("severity") == "INFO", "Information ").otherwise(F.initcap("severity"))

    def block(n: int, detail) -> list:
        return [
            F.lit(f" Event[{n}]\n  Log Name: Application\n  Source: "), F.col("source"),
            F.lit("\n  Date: "), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".0000000Z\n  Event ID: "),
            (F.col("id") + n).cast("string"), F.lit("\n  Level: "), level, F.lit("\n  Computer: HOST\n  Description: \n"),
            detail, F.lit("\n"),
        ]

    long_text = F.concat(F.repeat(F.lit("word  "), 60), F.col("message"))
    text = F.concat(*block(0, F.col("message")), *block(1, long_text))
    views.logs(spark, folder).select(text.alias("value")).write.text(path)


def _small_splits(spark, size: int):
    """Settings with splits of ``size`` bytes, so that blocks and quoted cells lie across many borders."""
    return _Setting(spark, "spark.sql.files.maxPartitionBytes", str(size))


class _Setting:
    """A session setting for the length of a block."""

    def __init__(self, spark, name: str, value: str):
        self.spark, self.name, self.value = spark, name, value

    def __enter__(self):
        self.old = self.spark.conf.get(self.name, None)
        self.spark.conf.set(self.name, self.value)

    def __exit__(self, *_):
        self.spark.conf.unset(self.name) if self.old is None else self.spark.conf.set(self.name, self.old)


def s_event_text(spark, folder):
    """The logs' event dumps, read back in splits that cut through blocks."""
    path = _folder(spark)
    event_dumps(spark, folder, path)
    with _small_splits(spark, 1 << 20):
        records = read_event_text(spark, path).drop("row_no")
    return parse_event_text(records, _now(), "Application", "10.1.1.1")


# --- Cleaning and layouts

def c_timestamp(spark, folder):
    raw = views.logs_raw(spark, folder)
    return raw.select("row_no", normalize_time(F.col("timestamp")).alias("timestamp"))


def c_status(spark, folder):
    raw = views.logs_raw(spark, folder)
    text = F.when(F.col("row_no") % 6 == 0, F.concat(F.lit("HTTP "), "status_code", F.lit(" seen"))).otherwise(F.col("status_code"))
    return raw.select("row_no", normalize_status(text).alias("status_code"))


def c_ip(spark, folder):
    raw = views.logs_raw(spark, folder)
    ip = F.when(F.col("row_no") % 9 == 0, "N/A").otherwise(F.concat(F.lit(" "), "ip_address", F.lit("\t")))
    return raw.select("row_no", normalize_ip(ip).alias("ip_address"))


def c_location(spark, folder):
    logs = views.logs(spark, folder)
    source = F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 20 == 0, "web-brazil").otherwise("web-mars")).otherwise(F.col("source"))
    return profiles.with_location(logs.withColumn("source", source)).select("id", "location")


def c_json(spark, folder):
    """Special numbers, control characters and nesting, cleaned."""
    e = views.events(spark, folder)
    number = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value") / 3)
    rows = e.select(
        F.col("event_id").alias("id"), number.alias("number"),
        F.concat(F.lit(" \u0007a\u001f"), "event_type", F.lit("\tb ")).alias("text"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("seen_at"),
        F.array(number, F.lit(1.0)).alias("list"),
        F.struct(number.alias("x"), F.array(F.struct(F.lit("\u0000y").alias("y"))).alias("z")).alias("deep"),
        F.create_map(F.lit("k"), number).alias("map"),
    )
    return sanitize(rows).select(
        "id", "number", "text", "seen_at", F.col("list")[0].alias("list_0"), F.col("deep.x").alias("deep_x"),
        F.col("deep.z")[0]["y"].alias("deep_y"), F.col("map")["k"].alias("map_k"),
    )


def _loose(spark, folder):
    return views.access_raw(spark, folder).withColumn("id", F.concat(F.lit("record-"), F.lpad(F.col("row_no").cast("string"), 8, "0"))).drop("row_no")


def c_clean_access(spark, folder):
    return layouts.clean_records(_loose(spark, folder), _now(), layouts.ACCESS)


def c_clean_logs(spark, folder):
    rows = views.logs_raw(spark, folder).withColumn("id", F.concat(F.lit("record-"), F.lpad(F.col("row_no").cast("string"), 8, "0"))).drop("row_no")
    return layouts.clean_records(rows, _now(), layouts.LOGS)


def c_clean_metrics(spark, folder):
    return layouts.clean_metrics(c_clean_logs(spark, folder))


def c_clean_in_place(spark, folder):
    return layouts.clean_in_place(views.logs(spark, folder))


def c_record(spark, folder):
    return layouts.records(explained(spark, folder))


def c_cloud_log(spark, folder):
    return layouts.cloud_logs(views.logs(spark, folder), _now())


def c_cloud_anomaly(spark, folder):
    return layouts.cloud_anomalies(explained(spark, folder), _now())


def c_cloud_explanation(spark, folder):
    rows = explained(spark, folder)
    return layouts.cloud_explanations(rows.filter("anomaly"), _now())


# --- Detection

def d_ip_profile(spark, folder):
    return profiles.ip_profile(profiles.profile(views.logs(spark, folder)))


def d_counts(spark, folder):
    found = profiles.profile(views.logs(spark, folder))
    return found.filter(F.col("kind").isin("event", "source", "location")).select("kind", "key", "n")


def d_trailing_count(spark, folder):
    return trailing.with_trailing_count(views.logs(spark, folder)).select("id", "n_5m")


def d_trailing_busy(spark, folder):
    """The same counts from stored blocks and rows in another order."""
    logs = views.logs(spark, folder)
    return trailing.with_trailing_count(logs.orderBy(F.xxhash64("id")), staged(trailing.blocks(logs))).select("id", "n_5m")


def d_burst_threshold(spark, folder):
    return trailing.burst_threshold(trailing.histogram(trailing.blocks(views.logs(spark, folder))))


def d_signals(spark, folder):
    return detection.signals(views.logs(spark, folder), use_forest=False)


def d_signals_null_event(spark, folder):
    """Logs of which some have no event type, beside a common one."""
    logs = views.logs(spark, folder).withColumn("event_type", F.when(F.col("id") % 9 != 0, F.lit("GET")))
    return detection.signals(logs, use_forest=False).filter("code = 'RARE_EVENT'").select("id", "points", "text")


def d_score(spark, folder):
    return scored(spark, folder).select("id", "anomaly", "anomaly_score")


def d_reason(spark, folder):
    return scored(spark, folder).select("id", "anomaly_reason")


def d_custom(spark, folder):
    """Own weights (a missing one keeps its default) and a threshold of 0."""
    weights = {"severity_error": 33, "rare_event": 1, "high_frequency": 0}
    return detection.detect(views.logs(spark, folder), 0, weights=weights, use_forest=False).select("id", "anomaly", "anomaly_score", "anomaly_reason")


def d_iforest(spark, folder):
    logs = views.logs(spark, folder)
    profile = profiles.take_profile(logs)
    return detection.features(logs, profile).select("id", "is_outlier")


def d_iforest_share(spark, folder):
    """Whether the forest keeps to its share, and flags exactly the scores above its limit."""
    logs = views.logs(spark, folder)
    profile = profiles.take_profile(logs)
    counted = staged(trailing.blocks(logs))
    rows = staged(detection.forest_features(detection.rule_features(logs, profile, counted), profile).select("id", *forest.FEATURES))
    fitted, scored = forest.fit(rows, profile.total)
    flags = forest.flagged(scored, fitted)
    return flags.agg(
        F.count(F.lit(1)).alias("n"), (F.count_if("is_outlier") <= 0.05 * F.count(F.lit(1))).alias("within_share"),
        (F.count_if("is_outlier") > 0).alias("some"), F.count_if(F.col("is_outlier") != (F.col("_score") > fitted.limit)).alias("wrong"),
    )


def d_detect_forest(spark, folder):
    """Scores with the forest, less its points where it flagged: those of the rules alone."""
    whole = detection.detect(views.logs(spark, folder))
    told = F.col("anomaly_reason").contains("Isolation Forest")
    rules = scored(spark, folder).select("id", F.col("anomaly_score").alias("rule_score"))
    both = staged(whole.join(rules, "id"))
    expected = F.least(F.lit(100.0), F.col("rule_score") + F.when(told, 15).otherwise(0))
    quiet = ~F.col("anomaly") & F.col("anomaly_score").isin(F.col("rule_score"), F.col("rule_score") + 15)
    right = (F.col("anomaly_score") == expected) & (F.col("anomaly") == (F.col("anomaly_score") >= 50))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(right | quiet)).alias("wrong"), (F.count_if(told) > 0).alias("some"))


def d_detect_all(spark, folder):
    return detection.detect(views.logs(spark, folder)).select("id", "anomaly", "anomaly_score", "anomaly_reason")


# --- Neighbours, joins, tables

def j_neighbours(spark, folder):
    rows = staged(scored(spark, folder))
    found = neighbours.neighbours(rows, rows.filter("anomaly"))
    return neighbours.timeline_rows(found)


def j_anomaly_to_log(spark, folder):
    rows = staged(explained(spark, folder))
    anomalies = layouts.cloud_anomalies(rows, _now())
    return tables.explained_anomalies(anomalies, rows).select("log_id", "anomaly_score", "ai_explanation", "ai_root_cause")


def j_cascade(spark, folder):
    rows = staged(explained(spark, folder))
    payload = sync.sync_all(rows, _now())
    gone = rows.filter(F.col("id") % 4 == 0).select(F.col("uuid").alias("id"))
    kept = tables.cascade(payload.logs, payload.anomalies, payload.explanations, gone)
    names = ("logs", "anomalies", "ai_analysis")
    parts = [part.select(F.lit(name).alias("target"), "id") for name, part in zip(names, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def y_upsert(spark, folder):
    """Changed and new rows, some keys twice and many under another day, upserted into a published table."""
    logs = views.logs(spark, folder)
    store = Store(spark, _folder(spark))
    store.upsert({"logs": tables.with_day(logs.filter(F.col("id") % 5 != 0))})
    copies = logs.filter(F.col("id") % 10 < 2).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    incoming = copies.withColumn("message", F.concat(F.lit("v"), F.col("version").cast("string")))
    moved = incoming.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    fresh = tables.newest(moved, "id", F.col("version")).drop("version")
    store.upsert({"logs": tables.with_day(fresh)})
    return store.read("logs").select("id", "timestamp", "message", F.col("dt").cast("string").alias("dt"))


def y_delete_many(spark, folder):
    logs, store = views.logs(spark, folder), Store(spark, _folder(spark))
    store.upsert({"logs": tables.with_day(logs)})
    store.delete("logs", logs.filter(F.col("source") == "svc-1").select("id"))
    return store.read("logs").select("id", "source")


def _undated(spark, folder):
    """Logs of which every seventh has no time."""
    return views.logs(spark, folder).withColumn("timestamp", F.when(F.col("id") % 7 != 0, F.col("timestamp")))


def y_upsert_null_day(spark, folder):
    """Rows with and without a day, upserted twice: some lose their time, others get one."""
    path, logs = _folder(spark), _undated(spark, folder)
    tables.append_logs(logs, path)
    change = logs.filter(F.col("id") % 5 == 0).withColumns({
        "message": F.lit("new"), "timestamp": F.when(F.col("id") % 2 == 0, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))})
    for _ in range(2):
        tables.upsert_table(spark, path, tables.with_day(change))
    return spark.read.parquet(path).select("id", "timestamp", "message", F.col("dt").cast("string").alias("dt"))


def y_delete_null_day(spark, folder):
    path, logs = _folder(spark), _undated(spark, folder)
    tables.append_logs(logs, path)
    tables.delete_from_table(spark, path, logs.filter(F.col("id") % 3 == 0).select("id"))
    return spark.read.parquet(path).select("id", F.col("dt").cast("string").alias("dt"))


def y_sync_narrow(spark, folder):
    """Anomalies in the four-column form, sent in two parts; the second repeats some and finds the form by the target."""
    path, rows = _folder(spark), staged(explained(spark, folder))
    dated = rows.withColumn("timestamp", F.when(F.col("id") % 7 != 0, F.col("timestamp")))
    for part, narrow in ((F.col("id") % 2 == 0, True), (F.col("id") % 3 != 1, False)):
        sync.write(spark, sync.sync_all(dated.filter(part), _now(), narrow=narrow), path)
    return sync.target(spark, path, "anomalies").withColumn("dt", F.col("dt").cast("string"))


def y_delete_one(spark, folder):
    return tables.delete(views.logs(spark, folder), [77]).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def y_clear_all(spark, folder):
    path = _folder(spark)
    tables.append_logs(views.logs(spark, folder), path)
    gone = tables.clear_table(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left_count")).withColumn("deleted_count", F.lit(gone).cast("long"))


def _sent(logs, anomalies, explanations):
    """The records of the three targets as rows of one table."""
    text = lambda *names: F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in names]).alias("content")
    parts = [
        logs and logs.select(F.lit("logs").alias("target"), "id", text("timestamp", "source", "event_type", "severity", "status_code", "ip_address", "message")),
        anomalies.select(F.lit("anomalies").alias("target"), "id", text("log_id", "is_anomaly", "is_anamoly", "reason", "detected_by", "created_at")),
        explanations.select(F.lit("ai_analysis").alias("target"), "id", text("anomaly_id", "explanation", "root_cause", "next_step", "model", "created_at")),
    ]
    parts = [p for p in parts if p is not None]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _targets(spark, root):
    return _sent(*[sync.target(spark, root, name) for name in sync.TARGETS])


def y_sync(spark, folder):
    path = _folder(spark)
    payload = sync.kept(sync.sync_all(staged(explained(spark, folder)), _now()))
    sync.write(spark, payload, path)
    sync.write(spark, payload, path)
    return _targets(spark, path)


def y_cascade(spark, folder):
    """Logs deleted from the stored targets, with all that hangs on them."""
    path, rows = _folder(spark), staged(explained(spark, folder))
    sync.write(spark, sync.sync_all(rows, _now()), path)
    sync.delete_logs(spark, path, rows.filter(F.col("id") % 4 == 0).select(F.col("uuid").alias("id")))
    return _targets(spark, path).select("target", "id")


def y_sync_one(spark, folder):
    rows = staged(explained(spark, folder))
    one = sync.sync_one(rows, 156, _now())
    return _sent(one.logs, one.anomalies, one.explanations)


def y_feed(spark, folder):
    fed = sync.feed_explanations(staged(explained(spark, folder)), _now())
    return _sent(fed.logs, fed.anomalies, fed.explanations)


# --- Explanations

def a_prompt(spark, folder):
    rows = staged(scored(spark, folder))
    context = neighbours.neighbours(rows, rows.filter("anomaly"))
    return explain.prompts(rows, context)


def replies(spark, folder):
    """A reply per log, in seven shapes from clean JSON to broken text."""
    row = views.logs(spark, folder)
    why, cause, step = F.concat(F.lit("seen on "), "source"), F.concat(F.lit("cause "), "event_type"), F.concat(F.lit("check "), "endpoint")

    def text(head: str, first: str, second: str, third: str, tail: str):
        return F.concat(F.lit(head + first), why, F.lit(second), cause, F.lit(third), step, F.lit(tail))

    shape = F.col("id") % 7
    reply = (
        F.when(shape == 0, text("", '{"explanation": "', '", "likely_root_cause": "', '", "recommended_next_step": "', '"}'))
        .when(shape == 1, text("```json\n", '{"explanation": "', '", "likely_root_cause": "', '", "recommended_next_step": "', '"}\n```'))
        .when(shape == 2, text("", '{"explanation": "', '", "likely_root_cause": "', '", "recommended_next_step": "', '",\n}'))
        .when(shape == 3, text("Here: ", '{"explanation": "', '", "root_cause": "', '", "next_step": "', '"} Done.'))
        .when(shape == 4, text("", "Explanation: ", "\nRoot Cause: ", "\nNext Step: ", "\n"))
        .when(shape == 5, "  ")
        .otherwise(text("", '{"explanation": "', '", "root_cause": "', '", "next_step": "', ""))
    )
    return row.select("id", reply.alias("reply"))


def a_parse_reply(spark, folder):
    return explain.parse_reply(replies(spark, folder)).drop("reply")


def a_attach(spark, folder):
    rows = staged(scored(spark, folder))
    answered = replies(spark, folder).withColumn("ai_model", F.lit("model-b"))
    return explain.attach(rows, answered, _now()).filter("anomaly").select("id", "ai_explanation", "ai_root_cause", "ai_next_step", "ai_model", "ai_analyzed_at")


def a_explain(spark, folder):
    """Anomalies explained by a function called on batches."""
    rows = staged(scored(spark, folder))

    def model(batch):
        heads = batch["prompt"].str.extract(r"- Source Service: (.*)", expand=False)
        return '{"explanation": "about ' + heads + '", "root_cause": "load"}'

    answers = explain.explain(explain.prompts(rows), model, "model-c")
    return explain.parse_reply(answers).select("id", "ai_model", "explanation", "likely_root_cause")


# --- Streams: the event table as a file stream, run to its end

def _stream(spark, folder):
    kind = spark.read.parquet(f"{folder}/events.parquet").schema
    return views.logs_from_events(live.read_logs(spark, f"{folder}/events*.parquet", kind))


def l_window_counts(spark, folder):
    return live.window_counts(views.logs(spark, folder))


def l_window_counts_stream(spark, folder):
    """Only windows the watermark has closed are emitted."""
    path, marks = _folder(spark), _folder(spark)
    counts = live.window_counts(_stream(spark, folder))
    query = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def l_dedup(spark, folder):
    path, marks = _folder(spark), _folder(spark)
    twice = _stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    query = live.viewer_dedup(twice).writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select("id", "source")


def l_live_score(spark, folder):
    """The stream scored by the statistics of the whole table, stored by day and batch."""
    table, saved, marks = _folder(spark), _folder(spark), _folder(spark)
    live.save_statistics(views.logs(spark, folder), saved, use_forest=False)
    live.start(_stream(spark, folder), live.scoring_sink(table, saved), marks).awaitTermination()
    return spark.read.parquet(table).select("id", "anomaly", "anomaly_score", "anomaly_reason")


def l_live_forest(spark, folder):
    """The stream scored by the statistics of the whole table, forest included, against the batch job."""
    table, saved, marks = _folder(spark), _folder(spark), _folder(spark)
    logs = views.logs(spark, folder)
    live.save_statistics(logs, saved)
    live.start(_stream(spark, folder), live.scoring_sink(table, saved), marks).awaitTermination()
    result = ("anomaly", "anomaly_score", "anomaly_reason")
    batch = detection.detect(logs).select("id", F.struct(*result).alias("batch"))
    both = spark.read.parquet(table).select("id", F.struct(*result).alias("live")).join(batch, "id", "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("live").eqNullSafe(F.col("batch"))).alias("differing"))


def l_event_text_live(spark, folder):
    """Captured dumps as a stream, to stored and scored logs, each held against the batch job on the same records."""
    path, table, saved, marks = (_folder(spark) for _ in range(4))
    event_dumps(spark, folder, path)
    read = {"channel": "Application", "ip": "10.1.1.1"}
    whole = staged(live.captured_logs(lines_of(spark.read.text(path)), 0, _now(), **read))
    live.save_statistics(whole, saved, use_forest=False)
    live.start(live.read_capture(spark, path), live.capture_sink(table, saved, _now(), **read), marks).awaitTermination()
    result = F.struct("source", "message", "anomaly", "anomaly_score", "anomaly_reason")
    batch = detection.detect(whole, use_forest=False).select("id", result.alias("_batch"))
    both = spark.read.parquet(table).join(batch, "id", "left")
    return both.select("timestamp", "source", "endpoint", "severity", "status_code", "message", result.eqNullSafe(F.col("_batch")).alias("as_batch"))


def l_trailing_state(spark, folder):
    """Trailing counts by a stream with state; only cells that the watermark has passed are written."""
    path, marks = _folder(spark), _folder(spark)
    counts = live.trailing_state(_stream(spark, folder))
    query = counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def l_counters(spark, folder):
    table, saved, marks = _folder(spark), _folder(spark), _folder(spark)
    live.save_statistics(views.logs(spark, folder), saved, use_forest=False)
    live.start(_stream(spark, folder), live.scoring_sink(table, saved), marks).awaitTermination()
    return live.running_counters(spark.read.parquet(table))


def l_newest(spark, folder):
    path, marks = _folder(spark), _folder(spark)
    live.start(_stream(spark, folder), live.newest_sink(path), marks).awaitTermination()
    return spark.read.parquet(path).select("id", "timestamp", "source")


def l_live_sync(spark, folder):
    table, saved, root, marks = (_folder(spark) for _ in range(4))
    live.save_statistics(views.logs(spark, folder), saved, use_forest=False)
    live.start(_stream(spark, folder), live.scoring_sink(table, saved, targets=root), marks).awaitTermination()
    return _targets(spark, root)


PREFIXES = ("q_", "k_", "v_", "s_", "c_", "d_", "j_", "y_", "a_", "l_")
QUERIES = {name: item for name, item in list(globals().items()) if name.startswith(PREFIXES) and callable(item)}

"""The checking SQL of the registered queries, for an independent engine.

Written from the rules, not from the Spark code: windows over whole groups,
brute-force neighbour ranking, a format list for times.
"""

from __future__ import annotations

LOGS = r"""
base AS (
  SELECT event_id AS id, ts, user_id AS u, event_type AS e, value AS v,
         CAST(regexp_extract(props, '\d+') AS INTEGER) AS k
  FROM events
), parts AS (
  SELECT id, v,
    make_timestamp((1704067200 + (epoch_us(ts) - 1704067200000000) // 50000000) * 1000000) AS timestamp,
    CASE WHEN u % 17 = 0 THEN 'web-bot' ELSE 'svc-' || (u % 8) END AS source,
    CASE WHEN id % 2500 = 7 THEN 'KERNEL_PANIC'
         WHEN e = 'click' THEN 'PUT' WHEN e = 'view' THEN 'GET' WHEN e = 'purchase' THEN 'POST'
         WHEN e = 'signup' THEN 'LOGIN' WHEN k % 4 = 0 THEN 'DELETE' ELSE 'GET' END AS event_type,
    CASE WHEN k <> 99 THEN '10.0.0.' || (u % 60) END AS ip_address,
    CAST(CASE WHEN e = 'error' THEN CASE k % 6 WHEN 0 THEN 500 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 401 WHEN 4 THEN 403 END
         WHEN e = 'signup' THEN 201 ELSE 200 END AS INTEGER) AS status_code,
    CASE WHEN id % 997 = 5 THEN 'North Korea' WHEN id % 4000 = 11 THEN 'Iceland' WHEN id % 10 = 0 THEN NULL
         ELSE (['USA','Germany','India','France','Brazil','Canada','China'])[
           CAST((CASE WHEN u % 60 IN (3, 4) THEN id ELSE u % 60 END) % 7 + 1 AS INTEGER)] END AS place
  FROM base
), logs AS (
  SELECT id, timestamp, source, event_type,
    CASE WHEN v >= 200 THEN 'CRITICAL' WHEN status_code >= 500 THEN 'ERROR'
         WHEN status_code IN (401, 403, 404) THEN 'WARNING' ELSE 'INFO' END AS severity,
    ip_address, status_code,
    '/api/v1/' || lower(event_type) AS endpoint,
    concat_ws(' | ', event_type || ' /api/v1/' || lower(event_type), 'HTTP ' || status_code, 'Location: ' || place) AS message
  FROM parts
)"""

WINDOWED = LOGS + """, counted AS (
  SELECT *,
    count(*) OVER (PARTITION BY source ORDER BY timestamp RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY source, timestamp)
      + row_number() OVER (PARTITION BY source, timestamp ORDER BY id) AS n_5m
  FROM logs
), burst AS (
  SELECT CASE WHEN count(*) >= 10 THEN greatest(5.0::DOUBLE, quantile_cont(n_5m, 0.95)::DOUBLE) ELSE 5.0::DOUBLE END AS threshold
  FROM counted
)"""

LOCATED = r"""located AS (
  SELECT *, CASE
      WHEN trim(regexp_extract(message, 'Location:\s*([^|]+)', 1, 'i')) <> ''
        THEN trim(regexp_extract(message, 'Location:\s*([^|]+)', 1, 'i'))
      WHEN starts_with(source, 'web-') AND lower(trim(replace(source, 'web-', ''))) IN
        ('north korea', 'germany', 'brazil', 'india', 'usa', 'france', 'canada', 'china')
        THEN trim(replace(source, 'web-', '')) END AS location
  FROM {rows}
)"""


def _signals(weights: dict[str, int] | None = None) -> str:
    w = {
        "geo_high_risk": 60, "geo_spoofing_ip": 55, "bot_malicious_action": 50, "severity_critical": 35,
        "high_frequency": 25, "status_repeated_404": 20, "status_auth_fail": 15, "rare_event": 10,
        "severity_error": 10, "status_500_plus": 10, **(weights or {}),
    }
    return WINDOWED + ", " + LOCATED.format(rows="counted") + f""", size AS (SELECT count(*) AS n FROM logs),
ips AS (
  SELECT ip_address, count(DISTINCT location) AS hops, count(*) FILTER (status_code = 404) AS n_404
  FROM located WHERE ip_address <> '' GROUP BY ip_address
), places AS (SELECT location, count(*) AS n_place FROM located WHERE location IS NOT NULL GROUP BY location),
kinds AS (SELECT event_type, count(*) AS n_event FROM located GROUP BY event_type),
featured AS (
  SELECT l.*, i.hops, i.n_404, p.n_place, t.n_event, burst.threshold AS burst_limit,
         greatest(1, floor(size.n * 0.005)) AS place_limit, greatest(1, floor(size.n * 0.01)) AS event_limit
  FROM located l LEFT JOIN ips i USING (ip_address) LEFT JOIN places p USING (location)
  LEFT JOIN kinds t USING (event_type) CROSS JOIN burst CROSS JOIN size
), signals AS (
  SELECT id, 1 AS ord, 'HIGH_RISK_GEO' AS code, {w["geo_high_risk"]} AS points,
         'originates from high-risk/anomalous geographic location ''' || location || '''' AS text
  FROM featured WHERE location IS NOT NULL AND
    (lower(location) IN ('north korea', 'kp', 'syria', 'iran', 'cuba') OR n_place <= place_limit)
  UNION ALL SELECT id, 2, 'GEO_SPOOFING_IP', {w["geo_spoofing_ip"]},
    'IP address ' || ip_address || ' exhibited rotating geographic hops across ' || hops || ' distinct countries'
  FROM featured WHERE hops >= 3
  UNION ALL SELECT id, 3, 'MALICIOUS_BOT_ACTION', {w["bot_malicious_action"]},
    'automated Bot client attempted destructive HTTP ' || event_type || ' operation'
  FROM featured WHERE (lower(source) LIKE '%bot%' OR lower(message) LIKE '%agent: bot%')
    AND event_type IN ('DELETE', 'PUT') AND (lower(location) = 'north korea' OR status_code >= 400)
  UNION ALL SELECT id, 4, 'CRITICAL_SEVERITY', {w["severity_critical"]}, 'has CRITICAL severity level'
  FROM featured WHERE severity = 'CRITICAL'
  UNION ALL SELECT id, 5, 'ERROR_SEVERITY', {w["severity_error"]}, 'has ERROR severity level'
  FROM featured WHERE severity = 'ERROR'
  UNION ALL SELECT id, 6, 'FREQUENCY_BURST', {w["high_frequency"]},
    'occurred during an unusually high burst of ' || n_5m || ' events in 5 minutes from ''' || source || ''''
  FROM featured WHERE n_5m >= burst_limit
  UNION ALL SELECT id, 7, 'HTTP_AUTH_DENIED', {w["status_auth_fail"]},
    'returned authentication/authorization denial HTTP ' || status_code
  FROM featured WHERE status_code IN (401, 403)
  UNION ALL SELECT id, 8, 'REPEATED_404', {w["status_repeated_404"]},
    'part of a repeated 404 pattern (' || n_404 || ' occurrences from IP ' || ip_address || ')'
  FROM featured WHERE status_code = 404 AND n_404 >= 3
  UNION ALL SELECT id, 9, 'HTTP_5XX_ERROR', {w["status_500_plus"]}, 'returned HTTP server error ' || status_code
  FROM featured WHERE status_code >= 500
  UNION ALL SELECT id, 10, 'RARE_EVENT', {w["rare_event"]},
    'is an unusual event type ''' || event_type || ''' (occurring in <=1% of logs)'
  FROM featured WHERE n_event <= event_limit
)"""


def _scored(threshold: int = 50, weights: dict[str, int] | None = None) -> str:
    return _signals(weights) + f""", sums AS (
  SELECT id, sum(points) AS total, string_agg(text, ', ' ORDER BY ord) AS texts FROM signals GROUP BY id
), points AS (
  SELECT l.*, least(100, coalesce(s.total, 0))::DOUBLE AS anomaly_score, s.texts
  FROM logs l LEFT JOIN sums s USING (id)
), scored AS (
  SELECT * EXCLUDE (texts), anomaly_score >= {threshold} AS anomaly,
    CASE WHEN anomaly_score >= {threshold} AND texts IS NOT NULL
           THEN 'Flagged with anomaly score ' || anomaly_score::INTEGER || '/100 because the log ' || texts || '.'
         WHEN anomaly_score >= {threshold}
           THEN 'Flagged with anomaly score ' || anomaly_score::INTEGER || '/100 exceeding threshold of {threshold}.'
         ELSE 'Normal log activity (score: ' || anomaly_score::INTEGER || '/100).' END AS anomaly_reason
  FROM points
)"""


SCORED = _scored()
EXPLAINED = SCORED + """, explained AS (
  SELECT *, 'log-000000-' || id AS uuid,
    CASE WHEN anomaly AND id % 3 = 0 THEN ' why ' || event_type END AS ai_explanation,
    CASE WHEN anomaly AND id % 6 = 0 THEN 'cause ' || source END AS ai_root_cause,
    CASE WHEN anomaly AND id % 3 = 0 THEN 'model-a' END AS ai_model
  FROM scored
)"""

RAW = LOGS + """, doubled AS (
  SELECT *, 0 AS r FROM logs UNION ALL SELECT *, 1 AS r FROM logs WHERE id % 50 = 0
), raw AS (
  SELECT id + 1 + r * 10000000 AS row_no,
    CASE WHEN id % 109 = 0 THEN '' WHEN id % 113 = 0 THEN 'not-a-date'
      WHEN id % 5 = 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S') WHEN id % 5 = 1 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
      WHEN id % 5 = 2 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') WHEN id % 5 = 3 THEN strftime(timestamp, '%Y/%m/%d %H:%M:%S')
      ELSE strftime(timestamp, '%d-%m-%Y %H:%M:%S') END AS timestamp,
    CASE WHEN id % 127 = 0 THEN '' ELSE ' ' || source || ' ' END AS source,
    CASE WHEN id % 131 = 0 THEN '' ELSE lower(event_type) END AS event_type,
    CASE WHEN id % 137 = 0 THEN 'BAD' WHEN id % 139 = 0 THEN '' WHEN id % 3 = 0 THEN lower(severity) ELSE severity END AS severity,
    ip_address,
    CASE WHEN id % 149 = 0 THEN '999' WHEN id % 151 = 0 THEN 'abc' WHEN status_code IS NULL THEN 'nan'
         WHEN id % 4 = 1 THEN status_code || '.0' ELSE status_code::VARCHAR END AS status_code,
    CASE WHEN id % 7 = 0 THEN '' ELSE endpoint END AS endpoint,
    CASE WHEN id % 11 = 0 THEN '' ELSE message END AS message
  FROM doubled
)"""

_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d %H:%M:%S', '%d-%m-%Y %H:%M:%S']"

CHECKED = RAW + f""", typed AS (
  SELECT row_no, timestamp AS time_text, try_strptime(replace(timestamp, 'Z', ''), {_FORMATS}) AS timestamp,
    trim(source) AS source, upper(event_type) AS event_type, severity AS severity_text, upper(severity) AS severity,
    ip_address, status_code AS status_text,
    CASE WHEN status_code <> 'nan' THEN TRY_CAST(status_code AS DOUBLE) END AS number,
    endpoint AS endpoint_text, message AS message_text
  FROM raw
), filled AS (
  SELECT row_no, timestamp, source, event_type, severity, ip_address, number::INTEGER AS status_code,
    coalesce(nullif(endpoint_text, ''), '/api/v1/' || lower(event_type)) AS endpoint,
    message_text, time_text, severity_text, status_text, number
  FROM typed
), errors AS (
  SELECT row_no, 'timestamp' AS field, 'Missing required timestamp field.' AS message FROM filled WHERE time_text = ''
  UNION ALL SELECT row_no, 'timestamp', 'Invalid timestamp format: ''' || time_text || '''.'
  FROM filled WHERE time_text <> '' AND timestamp IS NULL
  UNION ALL SELECT row_no, 'status_code', 'Invalid status code numeric value: ''' || status_text || '''.'
  FROM filled WHERE timestamp IS NOT NULL AND status_text <> 'nan' AND number IS NULL
  UNION ALL SELECT row_no, 'status_code', 'HTTP status code must be between 100 and 599. Got ''' || status_text || '''.'
  FROM filled WHERE timestamp IS NOT NULL AND (number < 100 OR number >= 600)
  UNION ALL SELECT row_no, 'event_type', 'Missing required event_type/request_type field.'
  FROM filled WHERE timestamp IS NOT NULL AND event_type = ''
  UNION ALL SELECT row_no, 'source', 'Missing required field ''source''.'
  FROM filled WHERE timestamp IS NOT NULL AND event_type <> '' AND source = ''
  UNION ALL SELECT row_no, 'severity', 'Missing required field ''severity''.'
  FROM filled WHERE timestamp IS NOT NULL AND event_type <> '' AND source <> '' AND severity = ''
  UNION ALL SELECT row_no, 'severity',
    'Invalid severity ''' || severity_text || '''. Must be one of: CRITICAL, ERROR, INFO, WARNING.'
  FROM filled WHERE timestamp IS NOT NULL AND event_type <> '' AND source <> '' AND severity NOT IN ('', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')
), valid AS (
  SELECT row_no, timestamp, source, event_type, severity, ip_address, status_code, endpoint,
    coalesce(nullif(message_text, ''), concat_ws(' | ', event_type || ' ' || endpoint, 'HTTP ' || status_code)) AS message,
    row_number() OVER (PARTITION BY timestamp, source, event_type, status_code, ip_address ORDER BY row_no) > 1 AS is_duplicate
  FROM filled WHERE row_no NOT IN (SELECT row_no FROM errors)
)"""

ACCESS = LOGS + r""", access_raw AS (
  SELECT id + 1 AS row_no, timestamp, ip_address, event_type AS request_type, status_code,
    CASE WHEN id % 23 = 0 THEN '' WHEN source = 'web-bot' THEN 'Bot' WHEN id % 2 = 0 THEN 'Firefox' ELSE 'Internet Explorer' END AS agent,
    (1000 + id % 4000)::VARCHAR AS session, regexp_extract(message, 'Location: ([^|]+)', 1) AS location
  FROM logs
)"""

SUMMARY = CHECKED + """, summed AS (
  SELECT (SELECT count(*) FROM raw) AS total_processed, (SELECT count(*) FROM valid) AS valid_count,
    (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS rejected_count, (SELECT count(*) FROM errors) AS error_count,
    (SELECT count(*) FROM valid WHERE is_duplicate) AS duplicate_count, (SELECT count(*) > 0 FROM valid) AS is_valid
)"""

_NOW = "'2024-02-01T00:00:00'"

CLOUD_ANOMALIES = EXPLAINED + f""", cloud_anomalies AS (
  SELECT uuid AS id, uuid AS log_id, true AS is_anomaly, 'true' AS is_anamoly, anomaly_score, anomaly_reason AS reason,
    'Hybrid Rule-Based + Isolation Forest' AS detected_by, {_NOW} AS created_at
  FROM explained WHERE anomaly
)"""

NEIGHBOURS = SCORED + """, pairs AS (
  SELECT a.id AS target_id, b.*, b.timestamp <= a.timestamp AS earlier, b.timestamp >= a.timestamp AS later
  FROM scored a JOIN scored b ON a.id <> b.id AND (a.source = b.source OR a.ip_address IS NOT DISTINCT FROM b.ip_address)
  WHERE a.anomaly
), ranked AS (
  SELECT 'PREVIOUS' AS relative_position, *, -row_number() OVER (PARTITION BY target_id ORDER BY timestamp DESC, id DESC) AS ord
  FROM pairs WHERE earlier
  UNION ALL
  SELECT 'FOLLOWING', *, row_number() OVER (PARTITION BY target_id ORDER BY timestamp, id) FROM pairs WHERE later
), near AS (
  SELECT target_id, relative_position, id, timestamp, source, severity, status_code, message, ord FROM ranked WHERE abs(ord) <= 3
  UNION ALL
  SELECT id, 'CURRENT_ANOMALY', id, timestamp, source, severity, status_code, message, 0 FROM scored WHERE anomaly
)"""

REPLIES = LOGS + r""", replies AS (
  SELECT id, CASE id % 7
    WHEN 0 THEN '{"explanation": "' || why || '", "likely_root_cause": "' || cause || '", "recommended_next_step": "' || step || '"}'
    WHEN 1 THEN '```json' || chr(10) || '{"explanation": "' || why || '", "likely_root_cause": "' || cause || '", "recommended_next_step": "' || step || '"}' || chr(10) || '```'
    WHEN 2 THEN '{"explanation": "' || why || '", "likely_root_cause": "' || cause || '", "recommended_next_step": "' || step || '",' || chr(10) || '}'
    WHEN 3 THEN 'Here: {"explanation": "' || why || '", "root_cause": "' || cause || '", "next_step": "' || step || '"} Done.'
    WHEN 4 THEN 'Explanation: ' || why || chr(10) || 'Root Cause: ' || cause || chr(10) || 'Next Step: ' || step || chr(10)
    WHEN 5 THEN '  '
    ELSE '{"explanation": "' || why || '", "root_cause": "' || cause || '", "next_step": "' || step END AS reply
  FROM (SELECT id, 'seen on ' || source AS why, 'cause ' || event_type AS cause, 'check ' || endpoint AS step FROM logs)
), bare AS (
  SELECT id, trim(regexp_replace(regexp_replace(trim(reply), '^```(?:json)?\s*', '', 'i'), '\s*```$', ''), chr(10) || ' ') AS t FROM replies
), objects AS (
  SELECT id, t, CASE
    WHEN json_valid(t) AND left(t, 1) = '{' THEN t
    WHEN json_valid(regexp_extract(t, '(?s)\{.*\}')) AND regexp_extract(t, '(?s)\{.*\}') <> '' THEN regexp_extract(t, '(?s)\{.*\}')
    WHEN json_valid(regexp_replace(regexp_extract(t, '(?s)\{.*\}'), ',\s*([}\]])', '\1', 'g'))
      AND regexp_extract(t, '(?s)\{.*\}') <> '' THEN regexp_replace(regexp_extract(t, '(?s)\{.*\}'), ',\s*([}\]])', '\1', 'g')
    END AS j
  FROM bare
), parsed AS (
  SELECT id,
    CASE WHEN t = '' THEN 'Anomalous event pattern detected requiring investigation.'
      WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.explanation'), 'Anomalous event pattern detected.')
      ELSE coalesce(nullif(regexp_extract(t, '"explanation"\s*:\s*"([^"]*)"', 1, 'i'), ''),
        nullif(trim(regexp_extract(t, 'explanation\s*:\s*([^\n\r]+)', 1, 'i')), ''), left(t, 300)) END AS explanation,
    CASE WHEN t = '' THEN 'System anomaly or threshold deviation.'
      WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.likely_root_cause'), json_extract_string(j, '$.root_cause'), 'System error or threshold deviation.')
      ELSE coalesce(nullif(regexp_extract(t, '"root_cause"\s*:\s*"([^"]*)"', 1, 'i'), ''),
        nullif(trim(regexp_extract(t, 'Root Cause:\s*([^\n\r]+)', 1, 'i')), ''),
        'High-severity HTTP status or unusual request frequency.') END AS likely_root_cause,
    CASE WHEN t = '' THEN 'Check application error logs and verify service dependencies.'
      WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.recommended_next_step'), json_extract_string(j, '$.next_step'), 'Inspect surrounding logs and verify service status.')
      ELSE coalesce(nullif(regexp_extract(t, '"next_step"\s*:\s*"([^"]*)"', 1, 'i'), ''),
        nullif(trim(regexp_extract(t, 'Next Step:\s*([^\n\r]+)', 1, 'i')), ''),
        'Inspect service logs, verify downstream APIs, and monitor traffic patterns.') END AS recommended_next_step
  FROM objects
)"""

_RECORD = "id, timestamp, source, event_type, severity, ip_address, status_code, endpoint, message"
_VALID = "row_no, timestamp, source, event_type, severity, ip_address, status_code, endpoint, message, is_duplicate"
_SESSION = "trim(replace(replace({0}, '/session/', ''), '/', ''))"
_STATUS = r"""coalesce(TRY_CAST(nullif(regexp_extract({0}, '\b([1-5]\d\d)\b', 1), '') AS INTEGER),
    CASE WHEN TRY_CAST({0} AS DOUBLE) >= 100 AND TRY_CAST({0} AS DOUBLE) < 600 THEN TRY_CAST({0} AS DOUBLE)::INTEGER END)"""
_TIME = f"coalesce(strftime(try_strptime(replace(timestamp, 'Z', ''), {_FORMATS}), '%Y-%m-%dT%H:%M:%SZ'), nullif(timestamp, ''))"


def q(with_clause: str, select: str) -> str:
    return f"WITH {with_clause.strip()}\n{select.strip()}"


CLEAN_LOGS = RAW + f""", cleaned AS (
  SELECT 'record-' || lpad(row_no::VARCHAR, 8, '0') AS id,
    coalesce({_TIME}, '2024-02-01T00:00:00Z') AS timestamp,
    trim(coalesce(nullif(source, ''), 'api-service')) AS source,
    upper(coalesce(nullif(event_type, ''), 'SYSTEM_EVENT')) AS event_type,
    severity AS severity_text, {_STATUS.format("status_code")} AS status_code,
    coalesce(ip_address, '127.0.0.1') AS ip_address, message AS message_text
  FROM raw
), clean_logs AS (
  SELECT id, timestamp, source, event_type,
    upper(coalesce(nullif(severity_text, ''), CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END)) AS severity,
    status_code, ip_address,
    coalesce(nullif(message_text, ''), 'Event ' || event_type || ' on ' || source) AS message
  FROM cleaned
)"""

# The stream's scored logs, with names made from their content and no explanation.
LIVE = SCORED + """, live AS (
  SELECT *, left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid,
    NULL::VARCHAR AS ai_explanation, NULL::VARCHAR AS ai_root_cause, NULL::VARCHAR AS ai_model
  FROM (SELECT *, sha256(concat_ws('|', id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), source, event_type)) AS h FROM scored)
)"""


def _text(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(({c})::VARCHAR, '-')" for c in columns) + ") AS content"


def _sent(logs: str = "true", told: str = "anomaly", rows: str = "explained", clause: str = EXPLAINED, now: str = _NOW) -> str:
    """The records that go to the three targets: of the logs for which ``logs`` holds, explained where ``told`` does."""
    cleaned = _text("strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ')", "source", "event_type", "severity", "status_code", "coalesce(ip_address, '127.0.0.1')", "message")
    anomaly = _text("uuid", "true", "'true'", "anomaly_reason", "'Hybrid Rule-Based + Isolation Forest'", now)
    why = _text(
        "uuid", "trim(coalesce(ai_explanation, anomaly_reason))", "coalesce(ai_root_cause, 'Abnormal behavioral signature detected on ' || endpoint || '.')",
        "'Review IP network logs and verify user authentication authorization.'", "coalesce(ai_model, 'gemini-3.5-flash-lite')", now)
    return q(clause, f"""SELECT 'logs' AS target, uuid AS id, {cleaned} FROM {rows} WHERE {logs}
      UNION ALL SELECT 'anomalies', uuid, {anomaly} FROM {rows} WHERE anomaly AND {logs}
      UNION ALL SELECT 'ai_analysis', uuid, {why} FROM {rows} WHERE {logs} AND {told}""")


ORACLES = {
    # Explorer
    "q_search": q(LOGS, """SELECT * FROM logs WHERE message ILIKE '%LOCATION: g_rm%' OR endpoint ILIKE '%LOCATION: g_rm%'
      OR ip_address ILIKE '%LOCATION: g_rm%' OR event_type ILIKE '%LOCATION: g_rm%' OR source ILIKE '%LOCATION: g_rm%'"""),
    "q_filters": q(LOGS, """SELECT * FROM logs WHERE severity = 'ERROR' AND source = 'svc-3' AND message ILIKE '%api/v1%'
      AND timestamp BETWEEN '2024-01-01 00:00:00' AND '2024-01-01 23:59:59'"""),
    "q_date_range": q(LOGS, """SELECT count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM logs
      WHERE timestamp BETWEEN '2024-01-01 00:00:00' AND '2024-01-01 23:59:59'"""),
    "q_anomalies_only": q(SCORED, "SELECT id, anomaly_score FROM scored WHERE anomaly"),
    "q_page": q(LOGS, "SELECT * FROM logs ORDER BY status_code ASC NULLS FIRST, id LIMIT 25 OFFSET 50"),
    "q_page_after": q(LOGS, """SELECT * FROM logs WHERE (timestamp, id) < (TIMESTAMP '2024-01-01 06:00:00', 100)
      ORDER BY timestamp DESC, id DESC LIMIT 25"""),
    "q_page_info": q(LOGS, """SELECT count(*) AS total, 3::INTEGER AS page, ceil(count(*) / 25)::BIGINT AS pages, 25::INTEGER AS per_page,
      3 < ceil(count(*) / 25) AS has_next, true AS has_prev FROM logs WHERE severity = 'CRITICAL'"""),
    "q_point": q(LOGS, "SELECT * FROM logs WHERE id = 77"),
    "q_by_ids": q(LOGS, "SELECT * FROM logs WHERE id % 13 = 0"),
    "q_recent": q(SCORED, f"SELECT {_RECORD}, anomaly_score, anomaly_reason FROM scored WHERE anomaly ORDER BY timestamp DESC, id DESC LIMIT 6"),
    "q_sources": q(LOGS, "SELECT DISTINCT source FROM logs"),
    "q_ai_sample": q(SCORED, "SELECT id, timestamp FROM scored WHERE anomaly ORDER BY timestamp, id LIMIT 3"),
    # Dashboard
    "k_totals": q(EXPLAINED, """SELECT count(*) AS total_logs, count(*) FILTER (anomaly) AS total_anomalies,
      count(*) FILTER (anomaly AND severity = 'CRITICAL') AS critical_anomalies, count(ai_explanation) AS ai_analyses_count,
      round_even(count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) * 100.0::DOUBLE / count(*), 1) AS error_rate,
      round_even(count(*) FILTER (anomaly) * 100.0::DOUBLE / count(*), 1) AS anomaly_rate FROM explained"""),
    "k_severity": q(LOGS, """SELECT s.severity, count(l.id) AS n FROM (VALUES ('INFO'), ('WARNING'), ('ERROR'), ('CRITICAL')) s(severity)
      LEFT JOIN logs l USING (severity) GROUP BY s.severity"""),
    "k_by_source": q(SCORED, "SELECT source, count(*) AS n FROM scored WHERE anomaly GROUP BY source"),
    "k_timeline": q(SCORED, """SELECT strftime(timestamp, '%m-%d %H:%M') AS bucket, count(*) AS total, count(*) FILTER (anomaly) AS anomalies
      FROM scored GROUP BY bucket"""),
    "k_timeline_sampled": q(SCORED, """SELECT bucket, total, anomalies FROM (
      SELECT *, row_number() OVER (ORDER BY bucket) AS place, count(*) OVER () AS buckets FROM (
        SELECT strftime(timestamp, '%m-%d %H:%M') AS bucket, count(*) AS total, count(*) FILTER (anomaly) AS anomalies FROM scored GROUP BY bucket))
      WHERE (place - 1) % (CASE WHEN buckets > 25 THEN buckets // 25 + 1 ELSE 1 END) = 0"""),
    "k_bands": q(SCORED, """SELECT CASE WHEN anomaly_score >= 70 THEN 'red' WHEN anomaly_score >= 50 THEN 'amber' ELSE 'green' END AS band,
      count(*) AS n FROM scored GROUP BY band"""),
    "k_rolled_up": q(EXPLAINED + """, stored AS (
      SELECT * REPLACE (CASE WHEN id % 10 < 2 THEN timestamp + INTERVAL 1 DAY ELSE timestamp END AS timestamp,
        CASE WHEN id % 10 < 2 THEN 'moved' ELSE source END AS source)
      FROM explained WHERE (id % 5 <> 0 OR id % 10 < 2) AND id % 7 <> 0)""", """
      SELECT 'minute' AS part, strftime(timestamp, '%m-%d %H:%M') AS name, count(*) AS n, count(*) FILTER (anomaly) AS m FROM stored GROUP BY name
      UNION ALL SELECT 'source', source, count(*), NULL FROM stored WHERE anomaly GROUP BY source
      UNION ALL SELECT 'severity', s.severity, count(l.id), NULL FROM (VALUES ('INFO'), ('WARNING'), ('ERROR'), ('CRITICAL')) s(severity)
        LEFT JOIN stored l USING (severity) GROUP BY s.severity
      UNION ALL SELECT 'logs', 'all', count(*), count(*) FILTER (anomaly) FROM stored
      UNION ALL SELECT 'explained', 'all', count(ai_explanation), count(*) FILTER (anomaly AND severity = 'CRITICAL') FROM stored
      UNION ALL SELECT * FROM (SELECT 'recent', source, id, NULL FROM stored WHERE anomaly ORDER BY timestamp DESC, id DESC LIMIT 6)"""),
    # Validation
    "v_valid": q(CHECKED, f"SELECT {_VALID} FROM valid"),
    "v_errors": q(CHECKED, "SELECT row_no, field, message FROM errors"),
    "v_iso_forms": q(LOGS, """SELECT id, CASE id % 12
        WHEN 0 THEN strftime(t, '%Y%m%dT%H%M%S') WHEN 1 THEN strftime(t, '%G-W%V-%uT%H:%M:%S') WHEN 2 THEN strftime(t, '%Y-%m-%d_%H:%M:%S')
        WHEN 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S,500') WHEN 4 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 5 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.123456789Z')
        WHEN 6 THEN strftime(t, '%Y-%m-%dT%H:%M') WHEN 7 THEN strftime(t, '%Y-%m-%dT%H') WHEN 8 THEN strftime(t, '%Y%m%dT%H%M%S.25-0530')
        WHEN 9 THEN strftime(t, '%GW%V%u') WHEN 10 THEN strftime(t, '%Y-%m-%d %H:%M:%S Europe/Paris') ELSE strftime(t, '%Y-W54-1') END AS written,
      CASE WHEN id % 12 IN (0, 1, 2, 4) THEN t WHEN id % 12 = 3 THEN t + INTERVAL 500 MILLISECONDS WHEN id % 12 = 5 THEN t + INTERVAL 123456 MICROSECONDS
        WHEN id % 12 = 6 THEN date_trunc('minute', t) WHEN id % 12 = 7 THEN date_trunc('hour', t) WHEN id % 12 = 8 THEN t + INTERVAL 250 MILLISECONDS
        WHEN id % 12 = 9 THEN date_trunc('day', t) END AS parsed FROM (SELECT id, timestamp AS t FROM logs)"""),
    "v_error_head": q(CHECKED, "SELECT row_no::VARCHAR AS row, field, message FROM errors ORDER BY row_no, field DESC LIMIT 20"),
    "v_summary": q(SUMMARY, "SELECT * FROM summed"),
    "v_duplicates": q(CHECKED, "SELECT row_no FROM valid WHERE is_duplicate"),
    "v_access": q(ACCESS, f"""SELECT {_VALID} FROM (
      SELECT row_no, timestamp,
        CASE WHEN agent <> '' AND location <> '' THEN 'web-' || replace(lower(agent), ' ', '-') WHEN agent <> '' THEN 'web-' || lower(agent)
             WHEN location <> '' THEN 'web-' || lower(location) ELSE 'web-server-01' END AS source,
        request_type AS event_type,
        CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code IN (401, 403, 404) THEN 'WARNING' ELSE 'INFO' END AS severity,
        ip_address, status_code, '/session/' || session AS endpoint,
        concat_ws(' | ', request_type || ' /session/' || session, 'HTTP ' || status_code, 'Agent: ' || nullif(agent, ''),
          'Location: ' || nullif(location, ''), 'Session: ' || session) AS message,
        row_number() OVER (PARTITION BY timestamp, source, request_type, status_code, ip_address ORDER BY row_no) > 1 AS is_duplicate
      FROM (SELECT *, CASE WHEN agent <> '' AND location <> '' THEN 'web-' || replace(lower(agent), ' ', '-') WHEN agent <> '' THEN 'web-' || lower(agent)
             WHEN location <> '' THEN 'web-' || lower(location) ELSE 'web-server-01' END AS source FROM access_raw))"""),
    "v_import_report": q(SUMMARY, """SELECT true AS success, total_processed, valid_count AS imported_count, rejected_count, duplicate_count,
      'Successfully imported ' || valid_count || ' logs as is.' AS message, 0::BIGINT AS anomalies_detected FROM summed"""),
    "s_csv_scan": q(CHECKED, """SELECT timestamp, source, event_type, severity, ip_address, status_code, endpoint,
      replace(CASE WHEN message_text = '' THEN '' ELSE message END, ' | ', chr(10) || '"quoted", ') || CASE WHEN message_text = '' THEN message ELSE '' END AS message,
      is_duplicate FROM valid JOIN (SELECT row_no, message_text FROM filled) USING (row_no)"""),
    "s_csv_wide": q(CHECKED, "SELECT timestamp, source, event_type, severity, ip_address, status_code, endpoint, message FROM valid"),
    "s_csv_mixed": q(CHECKED, "SELECT timestamp, source, event_type, severity, ip_address, status_code, message FROM valid"),
    "s_csv_tab": q(CHECKED, "SELECT timestamp, source, event_type, severity, status_code FROM valid"),
    "s_csv_pipe": q(CHECKED, "SELECT timestamp, source, event_type, severity, status_code FROM valid"),
    "s_empty_checks": """SELECT name, field, message, (SELECT count(*) FROM events) AS n FROM (VALUES
      ('nothing', 'file', 'Uploaded file is completely empty.'), ('header', 'file', 'Dataset is empty. No log records found.')) t(name, field, message)""",
    "s_append": q(LOGS, "SELECT strftime(timestamp, '%Y-%m-%d') AS dt, count(*) AS n, max(id) AS last_id FROM logs GROUP BY dt"),
    "s_export": q(EXPLAINED, """SELECT id::VARCHAR AS "ID", strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS "Timestamp", source AS "Source",
      event_type AS "Event Type", severity AS "Severity", coalesce(ip_address, '') AS "IP Address", coalesce(status_code::VARCHAR, '') AS "Status Code",
      endpoint AS "Endpoint", message AS "Message", anomaly_score::VARCHAR AS "Anomaly Score", anomaly_reason AS "Anomaly Reason",
      coalesce(ai_explanation, '') AS "AI Explanation", coalesce(ai_root_cause, '') AS "AI Root Cause", '' AS "AI Next Step"
      FROM explained WHERE anomaly"""),
    "s_event_text": q(LOGS, """SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, source, 'WIN_APPLICATION' AS event_type, severity,
      CASE severity WHEN 'CRITICAL' THEN 503 WHEN 'ERROR' THEN 500 WHEN 'WARNING' THEN 403 ELSE 200 END::INTEGER AS status_code,
      '10.1.1.1' AS ip_address, '/system/application/' || (id + b) AS endpoint,
      CASE WHEN b = 0 THEN message ELSE left(repeat('word ', 60) || message, 300) || '...' END AS message
      FROM logs CROSS JOIN (VALUES (0), (1)) x(b)"""),
    # Cleaning
    "c_timestamp": q(RAW, f"SELECT row_no, {_TIME} AS timestamp FROM raw"),
    "c_status": q(RAW, f"""SELECT row_no, {_STATUS.format("t")} AS status_code FROM
      (SELECT row_no, CASE WHEN row_no % 6 = 0 THEN 'HTTP ' || status_code || ' seen' WHEN status_code <> 'nan' THEN status_code END AS t FROM raw)"""),
    "c_ip": q(RAW, "SELECT row_no, CASE WHEN row_no % 9 <> 0 THEN ip_address END AS ip_address FROM raw"),
    "c_location": q(LOGS + ", renamed AS (SELECT * REPLACE (CASE WHEN id % 20 = 0 THEN 'web-brazil' WHEN id % 10 = 0 THEN 'web-mars' ELSE source END AS source) FROM logs), "
                    + LOCATED.format(rows="renamed"), "SELECT id, location FROM located"),
    "c_json": """WITH n AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(value / 3, 6) END AS number,
      'a' || event_type || chr(9) || 'b' AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS seen_at FROM events)
      SELECT id, number, text, seen_at, number AS list_0, number AS deep_x, 'y' AS deep_y, number AS map_k FROM n""",
    "c_clean_access": q(ACCESS, """SELECT 'record-' || lpad(row_no::VARCHAR, 8, '0') AS id, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
      coalesce(ip_address, '127.0.0.1') AS ip_address, request_type AS event_type, status_code,
      CASE WHEN agent = '' THEN 'Api-service' ELSE upper(left(agent, 1)) || lower(substr(agent, 2)) END AS user_agent,
      session AS session_id, coalesce(nullif(location, ''), 'Global') AS location FROM access_raw"""),
    "c_clean_logs": q(CLEAN_LOGS, "SELECT * FROM clean_logs"),
    "c_clean_metrics": q(CLEAN_LOGS, """SELECT count(*) AS total_input, count(*) AS cleaned_count, 0::INTEGER AS nulls_repaired,
      count(timestamp) AS timestamps_normalized, count(status_code) AS status_codes_normalized FROM clean_logs"""),
    "c_clean_in_place": q(LOGS, "SELECT * REPLACE (coalesce(ip_address, '127.0.0.1') AS ip_address) FROM logs"),
    "c_record": q(EXPLAINED, """SELECT id, uuid, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, source, event_type, severity, ip_address, status_code, message, endpoint,
      anomaly, anomaly_score, anomaly_reason, ai_explanation, ai_root_cause, NULL::VARCHAR AS ai_next_step, ai_model, NULL::VARCHAR AS ai_analyzed_at,
      ai_explanation IS NOT NULL OR ai_root_cause IS NOT NULL AS has_ai_analysis, NULL::VARCHAR AS created_at FROM explained"""),
    "c_cloud_log": q(LOGS, f"""SELECT left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
      strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type, severity, source, ip_address, status_code, message, endpoint,
      {_NOW} AS created_at, {_NOW} AS updated_at
      FROM (SELECT *, sha256(concat_ws('|', id, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), source, event_type)) AS h FROM logs)"""),
    "c_cloud_anomaly": q(CLOUD_ANOMALIES, "SELECT * FROM cloud_anomalies"),
    "c_cloud_explanation": q(EXPLAINED, f"""SELECT uuid AS id, uuid AS anomaly_id, trim(coalesce(ai_explanation, anomaly_reason)) AS explanation,
      coalesce(ai_root_cause, 'Abnormal behavioral signature detected on ' || endpoint || '.') AS root_cause,
      'Review IP network logs and verify user authentication authorization.' AS next_step,
      coalesce(ai_model, 'gemini-3.5-flash-lite') AS model, {_NOW} AS created_at FROM explained WHERE anomaly"""),
    # Detection
    "d_ip_profile": q(LOGS + ", " + LOCATED.format(rows="logs"), """SELECT ip_address, count(*) AS n, count(*) FILTER (status_code = 404) AS n_404,
      count(DISTINCT location) AS n_locations FROM located WHERE ip_address IS NOT NULL GROUP BY ip_address"""),
    "d_counts": q(LOGS + ", " + LOCATED.format(rows="logs"), """SELECT 'event' AS kind, event_type AS key, count(*) AS n FROM located GROUP BY event_type
      UNION ALL SELECT 'source', source, count(*) FROM located GROUP BY source
      UNION ALL SELECT 'location', location, count(*) FROM located WHERE location IS NOT NULL GROUP BY location"""),
    "d_trailing_count": q(WINDOWED, "SELECT id, n_5m FROM counted"),
    "d_trailing_busy": q(WINDOWED, "SELECT id, n_5m FROM counted"),
    "d_burst_threshold": q(WINDOWED, "SELECT threshold FROM burst"),
    "d_signals": q(_signals(), """SELECT id, (row_number() OVER (PARTITION BY id ORDER BY ord) - 1)::INTEGER AS place, code, points::INTEGER AS points, text FROM signals"""),
    "d_signals_null_event": q(LOGS, """SELECT id, 10::INTEGER AS points,
      'is an unusual event type ''None'' (occurring in <=1% of logs)' AS text FROM logs WHERE id % 9 = 0"""),
    "d_iforest_share": q(LOGS, "SELECT count(*) AS n, true AS within_share, true AS some, 0::BIGINT AS wrong FROM logs"),
    "d_detect_forest": q(LOGS, "SELECT count(*) AS n, 0::BIGINT AS wrong, true AS some FROM logs"),
    "l_live_forest": q(LOGS, "SELECT count(*) AS n, 0::BIGINT AS differing FROM logs"),
    "d_score": q(SCORED, "SELECT id, anomaly, anomaly_score FROM scored"),
    "d_reason": q(SCORED, "SELECT id, anomaly_reason FROM scored"),
    "d_custom": q(_scored(0, {"severity_error": 33, "rare_event": 1, "high_frequency": 0}), "SELECT id, anomaly, anomaly_score, anomaly_reason FROM scored"),
    # Neighbours, joins, tables
    "j_neighbours": q(NEIGHBOURS, """SELECT target_id, (row_number() OVER (PARTITION BY target_id ORDER BY ord) - 1)::INTEGER AS place,
      relative_position, id, timestamp, source, severity, status_code, message FROM near"""),
    "j_anomaly_to_log": q(EXPLAINED, "SELECT uuid AS log_id, anomaly_score, ai_explanation, ai_root_cause FROM explained WHERE anomaly AND ai_explanation IS NOT NULL"),
    "j_cascade": q(EXPLAINED, """SELECT 'logs' AS target, uuid AS id FROM explained WHERE id % 4 <> 0
      UNION ALL SELECT 'anomalies', uuid FROM explained WHERE anomaly AND id % 4 <> 0
      UNION ALL SELECT 'ai_analysis', uuid FROM explained WHERE anomaly AND id % 4 <> 0"""),
    "y_upsert": q(LOGS, """SELECT id, CASE WHEN id % 10 < 2 THEN timestamp + INTERVAL 1 DAY ELSE timestamp END AS timestamp,
      CASE WHEN id % 10 < 2 THEN 'v2' ELSE message END AS message,
      strftime(CASE WHEN id % 10 < 2 THEN timestamp + INTERVAL 1 DAY ELSE timestamp END, '%Y-%m-%d') AS dt
      FROM logs WHERE id % 5 <> 0 OR id % 10 < 2"""),
    "y_delete_many": q(LOGS, "SELECT id, source FROM logs WHERE source <> 'svc-1'"),
    "y_upsert_null_day": q(LOGS, """SELECT id, ts AS timestamp, CASE WHEN id % 5 = 0 THEN 'new' ELSE message END AS message, strftime(ts, '%Y-%m-%d') AS dt
      FROM (SELECT *, CASE WHEN id % 10 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' WHEN id % 5 <> 0 AND id % 7 <> 0 THEN timestamp END AS ts FROM logs)"""),
    "y_delete_null_day": q(LOGS, "SELECT id, CASE WHEN id % 7 <> 0 THEN strftime(timestamp, '%Y-%m-%d') END AS dt FROM logs WHERE id % 3 <> 0"),
    "y_sync_narrow": q(EXPLAINED, """SELECT uuid AS id, uuid AS log_id, true AS is_anomaly, 'true' AS is_anamoly,
      CASE WHEN id % 7 <> 0 THEN strftime(timestamp, '%Y-%m-%d') END AS dt FROM explained WHERE anomaly AND (id % 2 = 0 OR id % 3 <> 1)"""),
    "y_delete_one": q(LOGS, "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM logs WHERE id <> 77"),
    "y_clear_all": q(LOGS, "SELECT 0::BIGINT AS left_count, count(*) AS deleted_count FROM logs"),
    "y_sync": _sent(),
    "y_cascade": q(EXPLAINED, """SELECT 'logs' AS target, uuid AS id FROM explained WHERE id % 4 <> 0
      UNION ALL SELECT 'anomalies', uuid FROM explained WHERE anomaly AND id % 4 <> 0
      UNION ALL SELECT 'ai_analysis', uuid FROM explained WHERE anomaly AND id % 4 <> 0"""),
    "y_sync_one": _sent("id = 156", "anomaly AND ai_explanation IS NOT NULL"),
    "y_feed": f"SELECT * FROM ({_sent()}) WHERE target <> 'logs'",
    # Explanations
    "a_parse_reply": q(REPLIES, "SELECT id, explanation, likely_root_cause, recommended_next_step FROM parsed"),
    "a_attach": q(REPLIES + SCORED[len(LOGS):], """SELECT s.id, explanation AS ai_explanation, likely_root_cause AS ai_root_cause,
      recommended_next_step AS ai_next_step, 'model-b' AS ai_model, TIMESTAMP '2024-02-01 00:00:00' AS ai_analyzed_at
      FROM scored s JOIN parsed p USING (id) WHERE anomaly"""),
    "a_explain": q(SCORED, """SELECT id, 'model-c' AS ai_model, 'about ' || source AS explanation, 'load' AS likely_root_cause FROM scored WHERE anomaly"""),
    # Streams
    "l_window_counts": q(LOGS, """SELECT date_trunc('minute', timestamp) - INTERVAL 1 MINUTE * b AS window_start, source, count(*) AS n,
      count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) AS errors FROM logs CROSS JOIN (VALUES (0), (1), (2), (3), (4)) x(b)
      GROUP BY window_start, source"""),
    "l_window_counts_stream": q(LOGS, """SELECT * FROM (SELECT date_trunc('minute', timestamp) - INTERVAL 1 MINUTE * b AS window_start, source, count(*) AS n,
      count(*) FILTER (severity IN ('ERROR', 'CRITICAL')) AS errors FROM logs CROSS JOIN (VALUES (0), (1), (2), (3), (4)) x(b)
      GROUP BY window_start, source) WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(timestamp) FROM logs) - INTERVAL 10 MINUTE"""),
    "l_trailing_state": q(WINDOWED, """SELECT id, n_5m FROM counted WHERE (epoch_us(timestamp) // 300000000 + 1) * 300000000
      < (SELECT epoch_us(max(timestamp)) FROM logs) - 600000000"""),
    "l_event_text_live": q(LOGS, """SELECT timestamp, source, severity, '/system/application/' || (id + b) AS endpoint, true AS as_batch,
      CASE severity WHEN 'CRITICAL' THEN 503 WHEN 'ERROR' THEN 500 WHEN 'WARNING' THEN 403 ELSE 200 END::INTEGER AS status_code,
      CASE WHEN b = 0 THEN message ELSE left(repeat('word ', 60) || message, 300) || '...' END AS message
      FROM logs CROSS JOIN (VALUES (0), (1)) x(b)"""),
    "l_dedup": q(LOGS, "SELECT id, source FROM logs"),
    "l_live_score": q(SCORED, "SELECT id, anomaly, anomaly_score, anomaly_reason FROM scored"),
    "l_counters": q(SCORED, "SELECT count(*) AS rows, count(*) FILTER (anomaly) AS anomalies FROM scored"),
    "l_newest": q(LOGS, "SELECT id, timestamp, source FROM logs ORDER BY timestamp DESC, id DESC LIMIT 200"),
    "l_live_sync": _sent(rows="live", clause=LIVE, now="(SELECT strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S') FROM logs)"),
}

# The prompt's text per anomaly, from the neighbour rows.
ORACLES["a_prompt"] = q(NEIGHBOURS, """
SELECT s.id, concat_ws(chr(10),
  'You help an operations and security team to understand one log entry.',
  'The entry was flagged by a rule-based detector; take that as given.',
  'Do NOT evaluate whether this log is anomalous.', '', 'Target Anomaly Log Data:',
  '- Timestamp: ' || strftime(s.timestamp, '%Y-%m-%d %H:%M:%S'), '- Source Service: ' || s.source,
  '- Event Type: ' || s.event_type, '- Severity: ' || s.severity, '- IP Address: ' || coalesce(s.ip_address, 'N/A'),
  '- HTTP Status Code: ' || coalesce(s.status_code::VARCHAR, 'N/A'), '- Endpoint: ' || s.endpoint, '- Log Message: ' || s.message,
  '- Calculated Anomaly Score: ' || s.anomaly_score || '/100', '- Programmatic Detection Reason: ' || s.anomaly_reason, '',
  'Surrounding Event Timeline Context:', c.lines, '', 'Instructions:',
  'Say why the entry matters for a system in production, what most likely caused it,',
  'and which concrete step should be taken next.', 'Answer only with JSON of this form:',
  '{', '  "explanation": "...",', '  "likely_root_cause": "...",', '  "recommended_next_step": "..."', '}', '') AS prompt
FROM scored s JOIN (
  SELECT target_id, string_agg('- [' || relative_position || '] Time: ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ' | Source: ' || source
    || ' | Severity: ' || severity || ' | Status: ' || coalesce(status_code::VARCHAR, 'None') || ' | Message: ' || message, chr(10) ORDER BY ord) AS lines
  FROM near GROUP BY target_id) c ON c.target_id = s.id
WHERE s.anomaly""")

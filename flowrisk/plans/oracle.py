"""DuckDB oracle SQL for the registered queries (same formulas, other engine).

Views available to every statement: the driver's tables by name. Each
statement re-derives the flow adapter with the fixed formulas.
"""

from __future__ import annotations

from flowrisk.schema import FLOW_COLUMNS, MODEL_FEATURES

_DUCK_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _derived(i: int, name: str, kind: str) -> str:
    """Column ``i`` of the flow record (the formula of sources/events.py)."""
    n = f"(event_id * {2 * i + 3} + user_id * {i + 1}) % {1000 + 7 * i}"
    v = f"CAST({n} AS DOUBLE) / 8" if kind == "double" else f"CAST({n} AS {_DUCK_TYPE[kind]})"
    return f"CASE WHEN event_id % 97 <> 0 THEN {v} END" if name == "Idle Std" else v


_DERIVED = [(i, n, t) for i, (n, t) in enumerate(FLOW_COLUMNS) if n not in ("Destination Port", "Flow Duration", "Label")]

# Flow adapter: events -> envelope + flow fields (same formulas as sources/events.py).
FLOWS = """
flows AS (
  SELECT
    'events.parquet-' || CAST(event_id AS VARCHAR) AS kafka_key,
    CAST(ts AS TIMESTAMP) AS kafka_timestamp,
    CAST(user_id * 37 % 65536 AS INTEGER) AS "Destination Port",
    CAST(round(value * 100, 0) AS BIGINT) AS "Flow Duration",
    CASE event_type WHEN 'signup' THEN 'Normal' WHEN 'click' THEN 'Recon' WHEN 'view' THEN 'WebAttack'
                    WHEN 'purchase' THEN 'Botnet' WHEN 'error' THEN 'DoS/DDoS' END AS "Label",
    CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2
                    WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS label_index,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    'sensor-0' || CAST(user_id % 3 + 1 AS VARCHAR) AS sensor_id,
    date_trunc('minute', CAST(ts AS TIMESTAMP)) AS event_time,
    '10.0.' || CAST(CAST(user_id * 37 % 65536 AS INTEGER) % 250 + 1 AS VARCHAR) || '.1' AS source_ip,
    """ + ",\n    ".join(f"{_derived(i, n, t)} AS {_q(n)}" for i, n, t in _DERIVED) + """
  FROM events
)"""

SEVERITY_CASE = """CASE {a} WHEN 'Botnet' THEN 85 WHEN 'BruteForce' THEN 75 WHEN 'DoS/DDoS' THEN 95
  WHEN 'Heartbleed' THEN 90 WHEN 'Infiltration' THEN 88 WHEN 'Normal' THEN 5 WHEN 'Recon' THEN 60
  WHEN 'WebAttack' THEN 70 ELSE 50 END"""

SCORED = FLOWS + """,
pred AS (
  SELECT *,
    CAST(CASE WHEN k % 17 = 0 THEN 99 WHEN k % 10 = 0 THEN (label_index + 1) % 5 ELSE label_index END AS DOUBLE) AS prediction,
    CAST((500 + k * 37 % 501) / 1000 AS DOUBLE) AS confidence
  FROM flows
),
decoded AS (
  SELECT *,
    CASE prediction WHEN 0 THEN 'Normal' WHEN 1 THEN 'Recon' WHEN 2 THEN 'WebAttack' WHEN 3 THEN 'Botnet'
                    WHEN 4 THEN 'DoS/DDoS' ELSE 'Unknown' END AS predicted_attack
  FROM pred
),
scored AS (
  SELECT *,
    'events_adapter' AS model_name,
    round(least(100.0, coalesce(confidence, 0.0) * 100.0 * CAST(0.6 AS DOUBLE)
                + CAST(""" + SEVERITY_CASE.format(a="predicted_attack") + """ AS DOUBLE) * CAST(0.4 AS DOUBLE)), 2) AS risk_score,
    kafka_timestamp AS created_at
  FROM decoded
)"""

AS_OF = "(SELECT CAST(max(ts) AS TIMESTAMP) FROM events)"

ALERTS = """,
alerts AS (
  SELECT kafka_key AS alert_id, predicted_attack AS attack_type, source_ip, risk_score, sensor_id,
         created_at AS "timestamp", created_at + INTERVAL 3600 SECOND AS expires_at
  FROM scored WHERE risk_score >= 80.0
)"""


def _w(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body.strip()


SQL: dict[str, str] = {}

SQL["scan_flows"] = _w(FLOWS, "SELECT * FROM flows")
SQL["enrich_flows"] = _w(FLOWS, "SELECT kafka_key, sensor_id, event_time, source_ip FROM flows")
SQL["decode_labels"] = _w(SCORED, "SELECT kafka_key, prediction, predicted_attack FROM scored")
SQL["risk_score"] = _w(
    SCORED,
    "SELECT kafka_key, predicted_attack, confidence, " + SEVERITY_CASE.format(a="predicted_attack")
    + " AS severity, risk_score FROM scored",
)
SQL["alerts"] = _w(SCORED + ALERTS, "SELECT * FROM alerts")
SQL["attack_breakdown"] = _w(
    SCORED, "SELECT predicted_attack AS attack_type, count(*) AS count FROM scored GROUP BY 1 ORDER BY 2 DESC, 1"
)
SQL["stats_summary"] = _w(
    SCORED,
    """SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS total_predictions,
              arg_min(attack_type, (-count, attack_type)) AS top_attack
       FROM (SELECT predicted_attack AS attack_type, count(*) AS count FROM scored GROUP BY 1)""",
)
SQL["top_ips"] = _w(
    SCORED, "SELECT source_ip, count(*) AS count FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
)
SQL["timeline"] = _w(
    SCORED,
    f"""SELECT date_trunc('hour', created_at) AS "timestamp", count(*) AS count FROM scored
        WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1""",
)
SQL["statistics_rows"] = _w(
    SCORED + """,
b AS (SELECT predicted_attack AS name, count(*) AS value FROM scored GROUP BY 1),
ips AS (SELECT source_ip AS name, count(*) AS value,
               row_number() OVER (ORDER BY count(*) DESC, source_ip) AS position
        FROM scored GROUP BY 1),
tl AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS value FROM scored
       WHERE created_at >= """ + AS_OF + """ - INTERVAL 24 HOUR GROUP BY 1)""",
    """SELECT 'summary' AS part, CAST(1 AS BIGINT) AS position, 'total_predictions' AS name,
              CAST((SELECT count(*) FROM scored) AS BIGINT) AS value
       UNION ALL SELECT 'summary', 2, 'total_alerts', (SELECT count(*) FROM scored WHERE risk_score >= 80.0)
       UNION ALL SELECT 'summary', 3, (SELECT arg_min(name, (-value, name)) FROM b), NULL
       UNION ALL SELECT 'attack_breakdown', row_number() OVER (ORDER BY value DESC, name), name, value FROM b
       UNION ALL SELECT 'top_ips', position, name, value FROM ips WHERE position <= 10
       UNION ALL SELECT 'timeline', row_number() OVER (ORDER BY h), strftime(h, '%Y-%m-%d %H:%M:%S'), value FROM tl""",
)
SQL["alert_counters"] = _w(SCORED + ALERTS, "SELECT attack_type, count(*) AS count FROM alerts GROUP BY 1")
SQL["attack_share"] = _w(
    SCORED,
    """SELECT attack_type, count, round(count * 100.0 / sum(count) OVER (), 2) AS percent
       FROM (SELECT predicted_attack AS attack_type, count(*) AS count FROM scored GROUP BY 1)""",
)
SQL["top_ip_bars"] = _w(
    SCORED,
    """SELECT row_number() OVER (ORDER BY count DESC, source_ip) AS rank, source_ip, count,
              CAST(round(count * 100.0 / max(count) OVER (), 0) AS INTEGER) AS bar_percent
       FROM (SELECT source_ip, count(*) AS count FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)""",
)
SQL["batch_metrics"] = _w(
    SCORED,
    """SELECT count(*) AS row_count, count(*) = 0 AS is_empty,
              count(*) FILTER (WHERE risk_score >= 80.0) AS high_risk FROM scored""",
)


# Columns of the flow adapter, in order (the FLOWS CTE above).
FLOW_ADAPTER_COLUMNS = ["kafka_key", "kafka_timestamp", "Destination Port", "Flow Duration", "Label", "label_index",
                        "k", "sensor_id", "event_time", "source_ip", *[n for _, n, _ in _DERIVED]]


def _parse_sql() -> str:
    fields = ",\n    ".join(
        f"TRY_CAST(json_extract_string(value, '$.{_q(n)}') AS {_DUCK_TYPE[t]}) AS {_q(n)}" for n, t in FLOW_COLUMNS
    )
    return _w(FLOWS + MESSAGES, f"""SELECT key AS kafka_key, "timestamp" AS kafka_timestamp,
    {fields},
    NOT json_valid(value) AS is_corrupt
  FROM messages""")


def _features_cte() -> str:
    rows = ", ".join(f"({_lit(f)}, {i + 1})" for i, f in enumerate(MODEL_FEATURES))
    return f""",
feat(feature, position) AS (VALUES {rows}),
cols AS (SELECT column_name FROM (DESCRIBE flows))"""


MESSAGES = """,
messages AS (
  SELECT kafka_key AS key,
         CAST(json_object(""" + ", ".join(f"{_lit(n)}, {_q(n)}" for n, _ in FLOW_COLUMNS) + """) AS VARCHAR) AS value,
         kafka_timestamp AS "timestamp"
  FROM flows
)"""

SQL["to_messages"] = _w(FLOWS + MESSAGES, "SELECT * FROM messages")
SQL["parse_events"] = _parse_sql()
SQL["verify_labels"] = _w(
    FLOWS + MESSAGES,
    """SELECT coalesce(json_extract_string(value, '$.Label'), 'UNKNOWN') AS label, count(*) AS count
       FROM messages GROUP BY 1 ORDER BY 2 DESC, 1""",
)

ISO = "'%Y-%m-%dT%H:%M:%S.%f'"
SQL["validate_events"] = _w(
    FLOWS + f""",
req AS (
  SELECT kafka_key AS request_id,
    json_object('sensor_id', sensor_id,
                'event_time', strftime(kafka_timestamp, {ISO}) || CASE WHEN k % 2 = 0 THEN '+02:00' ELSE '' END,
                'source_ip', source_ip,
                'destination_port', CAST(round("Flow Duration" * 2, 0) AS BIGINT) - 3,
                'flow_duration', CAST(k - 5 AS BIGINT),
                'label', "Label") AS b,
    "Destination Port" % 2 = 0 AS w
  FROM flows
),
bodies AS (SELECT request_id, CAST(CASE WHEN w THEN json_object('event', b) ELSE b END AS VARCHAR) AS body FROM req),
un AS (
  SELECT request_id, body, json_extract(body, '$.event') IS NOT NULL AS wrapped,
         CASE WHEN json_extract(body, '$.event') IS NOT NULL THEN CAST(json_extract(body, '$.event') AS VARCHAR) ELSE body END AS inner_body
  FROM bodies
),
f AS (
  SELECT request_id, wrapped, NOT json_valid(body) AS bad,
         wrapped AND json_type(inner_body) = 'NULL' AS no_event,
         json_extract_string(inner_body, '$.sensor_id') AS sensor_id,
         json_extract_string(inner_body, '$.event_time') AS et_text,
         json_extract_string(inner_body, '$.source_ip') AS source_ip,
         json_extract_string(inner_body, '$.destination_port') AS port_text,
         json_extract_string(inner_body, '$.flow_duration') AS dur_text,
         json_extract_string(inner_body, '$.label') AS label
  FROM un
),
g AS (
  SELECT *, TRY_CAST(regexp_replace(et_text, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', '') AS TIMESTAMP) AS event_time,
         TRY_CAST(port_text AS BIGINT) AS port, TRY_CAST(dur_text AS BIGINT) AS dur
  FROM f
),
r AS (
  SELECT *, concat_ws(';',
    CASE WHEN bad THEN 'malformed body' END,
    CASE WHEN no_event THEN 'missing event payload' END,
    CASE WHEN sensor_id IS NULL THEN 'sensor_id required' END,
    CASE WHEN length(sensor_id) < 1 THEN 'sensor_id too short' END,
    CASE WHEN length(sensor_id) > 128 THEN 'sensor_id too long' END,
    CASE WHEN et_text IS NULL THEN 'event_time required' END,
    CASE WHEN et_text IS NOT NULL AND event_time IS NULL THEN 'event_time invalid' END,
    CASE WHEN source_ip IS NULL THEN 'source_ip required' END,
    CASE WHEN length(source_ip) < 7 THEN 'source_ip too short' END,
    CASE WHEN length(source_ip) > 45 THEN 'source_ip too long' END,
    CASE WHEN port_text IS NULL THEN 'destination_port required' END,
    CASE WHEN port_text IS NOT NULL AND port IS NULL THEN 'destination_port not an integer' END,
    CASE WHEN port < 0 THEN 'destination_port below 0' END,
    CASE WHEN port > 65535 THEN 'destination_port above 65535' END,
    CASE WHEN dur_text IS NULL THEN 'flow_duration required' END,
    CASE WHEN dur_text IS NOT NULL AND dur IS NULL THEN 'flow_duration not an integer' END,
    CASE WHEN dur < 0 THEN 'flow_duration below 0' END,
    CASE WHEN length(label) > 64 THEN 'label too long' END) AS reject_reasons
  FROM g
)""",
    """SELECT request_id, wrapped, sensor_id, event_time, source_ip, CAST(port AS INTEGER) AS destination_port,
              dur AS flow_duration, label, reject_reasons, reject_reasons = '' AS valid FROM r""",
)

SQL["normalize_alerts"] = _w(
    SCORED + f""",
msgs AS (
  SELECT CAST(CASE WHEN risk_score >= 80.0
    THEN json_object('type', 'alert', 'data', json_object('id', kafka_key, 'attack_type', predicted_attack,
         'source_ip', source_ip, 'risk_score', risk_score, 'sensor_id', sensor_id, 'timestamp', strftime(created_at, {ISO})))
    ELSE json_object('id', kafka_key, 'predicted_attack', predicted_attack, 'source_ip', source_ip,
         'confidence', confidence, 'risk_score', risk_score, 'model_version', model_name,
         'timestamp', strftime(created_at, {ISO})) END AS VARCHAR) AS value
  FROM scored
),
p AS (
  SELECT CASE WHEN json_extract_string(value, '$.type') = 'alert' THEN CAST(json_extract(value, '$.data') AS VARCHAR)
              ELSE value END AS d,
         json_extract_string(value, '$.type') AS t
  FROM msgs
)""",
    """SELECT json_extract_string(d, '$.id') AS id,
              coalesce(json_extract_string(d, '$.source_ip'), '0.0.0.0') AS source_ip,
              coalesce(json_extract_string(d, '$.attack_type'), json_extract_string(d, '$.predicted_attack'), 'Unknown') AS predicted_attack,
              coalesce(TRY_CAST(json_extract_string(d, '$.confidence') AS DOUBLE), 0.0) AS confidence,
              coalesce(TRY_CAST(json_extract_string(d, '$.risk_score') AS DOUBLE), 0.0) AS risk_score,
              json_extract_string(d, '$.model_version') AS model_version,
              json_extract_string(d, '$.timestamp') AS "timestamp"
       FROM p WHERE t IS NULL OR t NOT IN ('connected', 'ping', 'pong')""",
)

RAW = """,
raw AS (
  SELECT sensor_id, event_time, source_ip, "Destination Port" AS destination_port,
         CAST("Flow Duration" AS BIGINT) AS flow_duration, "Label" AS label,
         CAST(NULL AS MAP(VARCHAR, VARCHAR)) AS metadata, kafka_timestamp, kafka_key
  FROM flows
),
upserted AS (
  SELECT sensor_id, event_time, source_ip, destination_port, flow_duration, label, metadata FROM (
    SELECT *, row_number() OVER (PARTITION BY sensor_id, event_time ORDER BY kafka_timestamp DESC, kafka_key DESC) AS rn
    FROM raw) WHERE rn = 1
)"""

SQL["raw_telemetry"] = _w(
    FLOWS + RAW, "SELECT sensor_id, event_time, source_ip, destination_port, flow_duration, label, metadata FROM raw"
)
SQL["raw_upsert"] = _w(FLOWS + RAW, "SELECT * FROM upserted")
SQL["recent_events"] = _w(
    FLOWS + RAW, "SELECT * FROM upserted WHERE sensor_id = 'sensor-01' ORDER BY event_time DESC LIMIT 100"
)
SQL["prediction_docs"] = _w(
    SCORED,
    """SELECT source_ip, predicted_attack, coalesce(confidence, 0.0) AS confidence, risk_score,
              CAST(NULL AS INTEGER) AS prediction_latency_ms, model_name, "Label" AS actual_label, sensor_id, created_at,
              kafka_key AS event_kafka_key, kafka_timestamp AS event_kafka_timestamp,
              "Destination Port" AS "event_Destination_Port", "Flow Duration" AS "event_Flow_Duration",
              "Label" AS "event_Label", """ + "".join(
        f'{_q(n)} AS {_q("event_" + n.replace(" ", "_").replace("/", "_"))}, ' for _, n, _ in _DERIVED) + """label_index AS event_label_index, k AS event_k, prediction AS event_prediction,
              CAST(NULL AS INTEGER) AS event_prediction_latency_ms
       FROM scored""",
)
SQL["prediction_variants"] = _w(
    SCORED,
    """SELECT sensor_id, predicted_attack, risk_score, created_at, kafka_key, "Destination Port" AS destination_port,
              CASE sensor_id WHEN 'sensor-01' THEN "Flow Duration" WHEN 'sensor-02' THEN "Flow Duration" END AS flow_duration,
              CASE WHEN sensor_id = 'sensor-01' THEN CAST("Idle Std" AS DOUBLE) END AS nullable_field, k
       FROM scored WHERE sensor_id IN ('sensor-01', 'sensor-02', 'sensor-03')""",
)
PAGE = "(SELECT * FROM scored WHERE predicted_attack = 'Botnet' ORDER BY created_at DESC, kafka_key DESC LIMIT 20 OFFSET 20)"
SQL["predictions_page"] = _w(
    SCORED,
    f"""SELECT row_number() OVER (ORDER BY created_at DESC, kafka_key DESC) + 20 AS row_number, kafka_key, source_ip,
               predicted_attack, confidence, risk_score, created_at FROM {PAGE}""",
)
SQL["predictions_page_source"] = _w(
    SCORED,
    """SELECT row_number() OVER (ORDER BY created_at DESC, kafka_key DESC) AS row_number, kafka_key, source_ip,
              predicted_attack, confidence, risk_score, created_at FROM scored WHERE source_ip = '10.0.38.1'
       ORDER BY created_at DESC, kafka_key DESC LIMIT 20""",
)
SQL["page_info"] = _w(
    SCORED,
    """SELECT count(*) AS total, 2 AS page, 20 AS page_size,
              CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS total_pages, 40 < count(*) AS has_more, 21 AS start_row
       FROM scored WHERE predicted_attack = 'Botnet'""",
)
SQL["recent_alerts"] = _w(
    SCORED + ALERTS, f"SELECT * FROM alerts WHERE expires_at > {AS_OF} ORDER BY \"timestamp\" DESC, alert_id DESC LIMIT 50"
)
SQL["latest_alerts"] = _w(
    SCORED + ALERTS, f"SELECT * FROM alerts WHERE expires_at > {AS_OF} ORDER BY \"timestamp\" DESC, alert_id DESC LIMIT 100"
)
SQL["alert_payloads"] = _w(
    SCORED + ALERTS,
    """SELECT alert_id, CAST(json_object('attack_type', attack_type, 'source_ip', source_ip, 'risk_score', risk_score,
              'sensor_id', sensor_id, 'timestamp', strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%gZ')) AS VARCHAR) AS payload
       FROM alerts""",
)
SQL["alert_key_time"] = _w(
    SCORED + ALERTS + """,
keyed AS (
  SELECT alert_id, risk_score >= 90 AS ms,
         CASE WHEN risk_score >= 90 THEN epoch_us("timestamp") // 1000 ELSE epoch_us("timestamp") // 1000000 END AS n
  FROM alerts
)""",
    f"""SELECT alert_id, 'alert:' || CAST(n AS VARCHAR) AS alert_key,
              coalesce(CASE WHEN n > 10000000000 THEN make_timestamp(n * 1000) ELSE make_timestamp(n * 1000000) END,
                       {AS_OF}) AS key_time
       FROM keyed""",
)
SQL["retention"] = _w(
    SCORED + ALERTS,
    f"""SELECT 'predictions' AS table_name,
              count(*) FILTER (WHERE created_at >= {AS_OF} - INTERVAL 7776000 SECOND) AS retained,
              count(*) FILTER (WHERE NOT (created_at >= {AS_OF} - INTERVAL 7776000 SECOND)) AS expired FROM scored
       UNION ALL
       SELECT 'alerts', count(*) FILTER (WHERE "timestamp" >= {AS_OF} - INTERVAL 3600 SECOND),
              count(*) FILTER (WHERE NOT ("timestamp" >= {AS_OF} - INTERVAL 3600 SECOND)) FROM alerts
       UNION ALL
       SELECT 'topic', count(*) FILTER (WHERE kafka_timestamp >= {AS_OF} - INTERVAL 86400 SECOND),
              count(*) FILTER (WHERE NOT (kafka_timestamp >= {AS_OF} - INTERVAL 86400 SECOND)) FROM scored""",
)
SQL["severity_bands"] = _w(
    SCORED,
    """SELECT kafka_key, risk_score, CASE WHEN risk_score > 90 THEN 'critical' WHEN risk_score > 80 THEN 'high'
              WHEN risk_score > 50 THEN 'medium' ELSE 'low' END AS severity_band FROM scored""",
)
SQL["confidence_bands"] = _w(
    SCORED + """,
n AS (SELECT kafka_key, CASE WHEN confidence > 1 THEN confidence / 100.0 ELSE confidence END AS c FROM scored)""",
    """SELECT kafka_key, c AS confidence,
              CASE WHEN c IS NULL THEN NULL WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_band,
              round(c * 100.0, 1) AS confidence_percent FROM n""",
)
SQL["scalar_suite"] = _w(
    SCORED,
    f"""SELECT kafka_key, strftime(created_at, '%H:%M') AS hh_mm,
              date_sub('second', created_at, {AS_OF}) AS age_seconds,
              trim('  ' || source_ip || ' ') AS ip_trimmed,
              replace(strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), 'Z', '+00:00') AS iso_time,
              regexp_replace(kafka_key, '^events\\.parquet-', '') AS key_suffix,
              CAST(ceil(risk_score) AS BIGINT) AS risk_ceil
       FROM scored""",
)
SQL["confidence_array"] = "SELECT vec_id, round(list_max(CAST(embedding AS DOUBLE[])), 6) AS confidence FROM embeddings"

PROFILES = """,
pt AS (SELECT source_ip, predicted_attack, count(*) AS n FROM scored GROUP BY 1, 2),
cnt AS (SELECT source_ip, CAST(sum(n) AS BIGINT) AS event_count,
               string_agg(predicted_attack || '=' || CAST(n AS VARCHAR), ',' ORDER BY predicted_attack) AS attack_counts
        FROM pt GROUP BY 1),
lat AS (
  SELECT source_ip, created_at AS last_seen, predicted_attack AS latest_attack, risk_score, sensor_id FROM (
    SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY created_at DESC, event_time DESC, kafka_key DESC) AS rn
    FROM scored) WHERE rn = 1
),
peak AS (SELECT source_ip, max(risk_score) AS peak_risk_score FROM scored GROUP BY 1)"""
PROFILE_SELECT = """SELECT source_ip, event_count, attack_counts, last_seen, latest_attack, risk_score, sensor_id, peak_risk_score
       FROM cnt JOIN lat USING (source_ip) JOIN peak USING (source_ip)"""
SQL["attacker_profiles"] = _w(SCORED + PROFILES, PROFILE_SELECT)
SQL["profile_merge"] = _w(SCORED + PROFILES, PROFILE_SELECT)
SQL["breakdown_entries"] = _w(
    SCORED, "SELECT source_ip, predicted_attack AS attack_type, count(*) AS count FROM scored GROUP BY 1, 2"
)
SQL["latest_prediction"] = _w(
    SCORED,
    """SELECT source_ip, kafka_key, predicted_attack, confidence, risk_score, created_at FROM (
         SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY created_at DESC, event_time DESC, kafka_key DESC) AS rn
         FROM scored) WHERE rn = 1""",
)

# The stream's own scoring: class and confidence from the wire, its default sensor, message time as clock.
STREAMED = FLOWS + """,
pred AS (
  SELECT kafka_key, source_ip, 'sensor-01' AS sensor_id, kafka_timestamp AS event_time, kafka_timestamp AS created_at,
    CASE "Destination Port" % 6 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Recon' WHEN 2 THEN 'WebAttack' WHEN 3 THEN 'Botnet'
                                WHEN 4 THEN 'DoS/DDoS' ELSE 'Unknown' END AS predicted_attack,
    CAST(("Flow Duration" % 500 + 500) / 1000 AS DOUBLE) AS confidence
  FROM flows
),
scored AS (
  SELECT *, round(least(100.0, confidence * 100.0 * CAST(0.6 AS DOUBLE)
                  + CAST(""" + SEVERITY_CASE.format(a="predicted_attack") + """ AS DOUBLE) * CAST(0.4 AS DOUBLE)), 2) AS risk_score
  FROM pred
)"""
SQL["stream_scored"] = _w(
    STREAMED, "SELECT kafka_key, source_ip, predicted_attack, confidence, risk_score, sensor_id, created_at FROM scored")
SQL["stream_dedup"] = _w(STREAMED, "SELECT kafka_key, predicted_attack, risk_score FROM scored")
SQL["stream_profiles"] = _w(STREAMED + PROFILES, PROFILE_SELECT)
SQL["stream_ingest"] = _w(
    FLOWS, "SELECT kafka_key, kafka_timestamp, " + ", ".join(
        f"CAST({_q(n)} AS {_DUCK_TYPE[t]}) AS {_q(n)}" for n, t in FLOW_COLUMNS)
    + """, false AS is_corrupt, CAST(NULL AS VARCHAR) AS corrupt_value, 'sensor-01' AS sensor_id,
       kafka_timestamp AS event_time, source_ip FROM flows""")
SQL["stream_recovered"] = _w(STREAMED + ALERTS, "SELECT * FROM alerts")
SQL["stream_counters"] = _w(
    STREAMED + """,
counted AS (
  SELECT count(*) AS published, count(*) FILTER (WHERE CAST(split_part(kafka_key, '-', -1) AS BIGINT) % 89 = 0) AS failed,
    count(*) FILTER (WHERE CAST(split_part(kafka_key, '-', -1) AS BIGINT) % 89 <> 0) AS good,
    count(*) FILTER (WHERE CAST(split_part(kafka_key, '-', -1) AS BIGINT) % 89 <> 0 AND risk_score >= 80) AS alerts
  FROM scored
)""",
    """SELECT CAST(published AS BIGINT) AS published, failed, good AS input_rows, alerts AS high_risk, alerts AS alerts_sent,
              good AS scored_rows, failed AS malformed_rows, alerts AS alert_rows, alerts AS message_rows FROM counted""")
SQL["raw_by_date"] = SQL["raw_upsert"]
SQL["recent_events_by_date"] = SQL["recent_events"]
SQL["predictions_seek"] = _w(
    SCORED,
    """SELECT kafka_key, source_ip, predicted_attack, confidence, risk_score, created_at FROM scored
       ORDER BY created_at DESC, kafka_key DESC LIMIT 20 OFFSET 3980""",
)
SQL["retention_sweep"] = _w(
    SCORED + ALERTS,
    f"""SELECT 'predictions' AS table_name, kafka_key AS id, source_ip, created_at FROM scored
          WHERE created_at >= {AS_OF} + INTERVAL 80 DAY - INTERVAL 90 DAY
       UNION ALL
       SELECT 'anomaly_reports', alert_id, source_ip, "timestamp" FROM alerts
          WHERE "timestamp" >= {AS_OF} + INTERVAL 170 DAY - INTERVAL 180 DAY""",
)
SQL["stream_alerts"] = _w(STREAMED + ALERTS, "SELECT * FROM alerts")
SQL["stream_attackers"] = _w(STREAMED + PROFILES, PROFILE_SELECT)

SQL["stream_live_profiles"] = _w(STREAMED + PROFILES, PROFILE_SELECT)
# Delay: a quarter of the whole time; one row in twenty comes when all others have been read.
SQL["stream_timeline"] = _w(
    FLOWS + """,
ends AS (SELECT min(kafka_timestamp) AS lo, max(kafka_timestamp) AS hi FROM flows),
timed AS (
  SELECT date_trunc('hour', kafka_timestamp) AS h,
    coalesce(k % 20 = 7, false) AND kafka_timestamp < hi
      AND epoch_us(date_trunc('hour', kafka_timestamp) + INTERVAL 1 HOUR)
          <= epoch_us(hi) - ((epoch_us(hi) - epoch_us(lo)) // 4 + 1) AS late
  FROM flows, ends WHERE kafka_timestamp IS NOT NULL
)""",
    """SELECT h AS "timestamp", count(*) FILTER (WHERE NOT late) AS count, count(*) FILTER (WHERE late) AS late
       FROM timed GROUP BY 1""",
)
SQL["topic_read"] = _w(
    FLOWS + """,
topic AS (
  SELECT CAST(event_id % 3 AS INTEGER) AS topic_partition, kafka_key AS key, kafka_timestamp AS "timestamp",
    row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id % 4 = 0, kafka_timestamp, kafka_key) - 1 AS topic_offset,
    count(*) OVER (PARTITION BY event_id % 3) AS n
  FROM (SELECT *, CAST(split_part(kafka_key, '-', 2) AS BIGINT) AS event_id FROM flows)
)""",
    """SELECT topic_partition, topic_offset, key, "timestamp" FROM topic
       WHERE topic_offset >= n // 4 AND topic_offset < 3 * n // 4""",
)

SQL["contract_profile"] = _w(
    FLOWS,
    """SELECT count(*) AS row_count, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE flows)) AS column_count,
              count(DISTINCT split_part(kafka_key, '-', 1)) AS file_count FROM flows""",
)
SQL["null_counts"] = _w(
    FLOWS,
    "\nUNION ALL\n".join(
        f"SELECT {_lit(c)} AS column_name, {i + 1} AS ordinal, count(*) FILTER (WHERE {_q(c)} IS NULL) AS null_count, "
        f"{'true' if c in ('Label', 'Destination Port', 'Flow Duration') else 'false'} AS critical FROM flows"
        for i, c in enumerate(FLOW_ADAPTER_COLUMNS)
    ),
)
SQL["contract_footers"] = _w(
    FLOWS,
    "\nUNION ALL\n".join(
        f"SELECT {_lit(c)} AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {_q(c)} IS NULL) AS null_count, "
        f"{'true' if c in ('Label', 'Destination Port', 'Flow Duration') else 'false'} AS critical FROM flows"
        for c in FLOW_ADAPTER_COLUMNS
    ),
)
SQL["contract_files"] = _w(
    FLOWS + """,
shaped AS (
  SELECT sensor_id, "Destination Port" AS port,
    CASE WHEN sensor_id <> 'sensor-02' THEN "Flow Duration" ELSE 0 END AS duration,
    CASE WHEN sensor_id <> 'sensor-01' OR (event_time IS NOT NULL AND k % 10 <> 3) THEN "Label" END AS label
  FROM flows WHERE sensor_id IN ('sensor-01', 'sensor-02', 'sensor-03')
),
summed AS (
  SELECT sensor_id AS folder, count(*) AS row_count,
    CASE sensor_id WHEN 'sensor-02' THEN 'Flow Duration' ELSE '' END AS missing,
    CASE sensor_id WHEN 'sensor-03' THEN 'Destination Port' ELSE '' END AS other_type,
    3 * count(*) - count(port) - count(duration) - count(label) AS critical_nulls
  FROM shaped GROUP BY sensor_id
)""",
    "SELECT *, missing = '' AND other_type = '' AND critical_nulls = 0 AS contract_ok FROM summed")
SQL["label_values"] = _w(FLOWS, 'SELECT DISTINCT "Label" AS label FROM flows WHERE "Label" IS NOT NULL ORDER BY 1')
SQL["missing_features"] = _w(
    FLOWS + _features_cte(),
    "SELECT feature, position FROM feat WHERE feature NOT IN (SELECT column_name FROM cols) ORDER BY position",
)
SQL["non_feature_columns"] = _w(
    FLOWS + _features_cte(),
    """SELECT column_name FROM cols WHERE column_name <> 'Label' AND column_name NOT IN (SELECT feature FROM feat)
       ORDER BY column_name""",
)
SQL["contract_ok"] = _w(
    FLOWS + _features_cte(),
    """SELECT m.missing_count, c.critical_nulls, m.missing_count = 0 AND c.critical_nulls = 0 AS contract_ok
       FROM (SELECT count(*) AS missing_count FROM feat WHERE feature NOT IN (SELECT column_name FROM cols)) m,
            (SELECT count(*) FILTER (WHERE "Label" IS NULL) + count(*) FILTER (WHERE "Destination Port" IS NULL)
                    + count(*) FILTER (WHERE "Flow Duration" IS NULL) AS critical_nulls FROM flows) c""",
)
SQL["feature_values"] = _w(
    FLOWS, "SELECT kafka_key, " + ", ".join(f"CAST({_q(f)} AS DOUBLE) AS {_q(f)}" for f in MODEL_FEATURES) + " FROM flows")
SQL["contract_summary"] = _w(
    FLOWS + _features_cte(),
    """SELECT 'events' AS source, (SELECT count(DISTINCT kafka_file) FROM (SELECT split_part(kafka_key, '-', 1) AS kafka_file FROM flows)) AS file_count,
              (SELECT count(*) FROM flows) AS row_count, (SELECT count(*) FROM cols) AS column_count,
              (SELECT string_agg(DISTINCT "Label", ',' ORDER BY "Label") FROM flows) AS label_values,
              (SELECT CAST(""" + " + ".join(f"count(*) FILTER (WHERE {_q(c)} IS NULL)" for c in FLOW_ADAPTER_COLUMNS)
    + """ AS BIGINT) FROM flows) AS nulls,
              c.critical_nulls, m.missing,
              (SELECT count(*) FROM cols WHERE column_name <> 'Label' AND column_name NOT IN (SELECT feature FROM feat)) AS non_features,
              m.missing = 0 AND c.critical_nulls = 0 AS contract_ok
       FROM (SELECT count(*) AS missing FROM feat WHERE feature NOT IN (SELECT column_name FROM cols)) m,
            (SELECT count(*) FILTER (WHERE "Label" IS NULL) + count(*) FILTER (WHERE "Destination Port" IS NULL)
                    + count(*) FILTER (WHERE "Flow Duration" IS NULL) AS critical_nulls FROM flows) c""",
)
SQL["confusion_matrix"] = _w(
    SCORED, 'SELECT "Label" AS actual, predicted_attack AS predicted, count(*) AS count FROM scored GROUP BY 1, 2'
)
SQL["weighted_f1"] = _w(
    SCORED + """,
cm AS (SELECT "Label" AS actual, predicted_attack AS predicted, count(*) AS count FROM scored GROUP BY 1, 2),
a AS (SELECT actual AS cls, sum(count) AS support, sum(CASE WHEN actual = predicted THEN count ELSE 0 END) AS tp
      FROM cm GROUP BY 1),
p AS (SELECT predicted AS cls, sum(count) AS predicted_n FROM cm GROUP BY 1)""",
    """SELECT CAST(sum(support) AS BIGINT) AS n,
              round(sum(CASE WHEN support + coalesce(predicted_n, 0) = 0 THEN 0.0
                             ELSE 2.0 * tp / (support + coalesce(predicted_n, 0)) END * support) / sum(support), 6) AS weighted_f1
       FROM a LEFT JOIN p USING (cls)""",
)


def all_sql() -> dict[str, str]:
    return dict(SQL)

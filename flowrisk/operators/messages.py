"""Wire messages: flow rows <-> JSON values, ingest-request validation.

Parsing is permissive like the streaming job it mirrors: malformed JSON gives
an all-null record, an out-of-range or fractional number for an int gives a
null field, NaN/Infinity are accepted for doubles. A ``is_corrupt`` flag lets
callers split bad rows into a quarantine output instead of dropping them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowrisk import schema as S
from flowrisk.functions import scalar as X

JSON_OPTS = {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def to_messages(df: DataFrame, value_cols: list[str], key: Column | str = "kafka_key",
                timestamp: Column | str = "kafka_timestamp", max_rows: int = 0) -> DataFrame:
    """Rows -> (key, value, timestamp) messages; nulls are written as JSON nulls.

    ``max_rows`` > 0 caps the output (the producer's ``--max-rows``); 0 = all.
    """
    k = X.col(key) if isinstance(key, str) else key
    ts = X.col(timestamp) if isinstance(timestamp, str) else timestamp
    out = df.select(
        k.cast("string").alias("key"),
        F.to_json(F.struct(*[X.col(c) for c in value_cols]), {"ignoreNullFields": "false"}).alias("value"),
        ts.alias("timestamp"),
    )
    return out.limit(max_rows) if max_rows and max_rows > 0 else out


def parse_messages(messages: DataFrame, schema: StructType = S.FLOW_SCHEMA, keep_value: bool = False) -> DataFrame:
    """(key, value, timestamp) -> kafka_key, kafka_timestamp, declared columns, is_corrupt.

    With ``keep_value`` a corrupt message's text comes along as ``corrupt_value``
    (null for good ones), so a quarantine can keep it. A message is parsed once; only
    one that gave no field at all is parsed again, to tell malformed text from a
    record of nulls."""
    v = F.col("_text")
    parsed = messages.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("value").cast("string").alias("_text"),
        F.from_json(F.col("value").cast("string"), schema, JSON_OPTS).alias("data"),
    )
    empty = F.coalesce(*[F.col("data")[f.name].cast("string") for f in schema.fields]).isNull()
    bad = F.when(empty, F.from_json(v, "map<string,string>", JSON_OPTS).isNull()).otherwise(F.lit(False))
    out = parsed.select("kafka_key", "kafka_timestamp", "data.*", bad.alias("is_corrupt"), "_text")
    if keep_value:
        out = out.withColumn("corrupt_value", F.when(F.col("is_corrupt"), v))
    return out.drop("_text")


def label_histogram(parsed: DataFrame, label_col: str = "Label", max_messages: int = 0) -> DataFrame:
    """Label counts, largest first; a missing label counts as ``UNKNOWN``.

    ``max_messages`` > 0 reads only the first N messages (a bounded check);
    0 reads all.
    """
    if max_messages and max_messages > 0:
        parsed = parsed.limit(max_messages)
    return (
        parsed.groupBy(F.coalesce(X.col(label_col), F.lit("UNKNOWN")).alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("label"))
    )


def live_messages(scored: DataFrame, threshold: float = S.RISK_ALERT_THRESHOLD) -> DataFrame:
    """Messages on the live channel: high-risk rows as wrapped alerts
    (``{"type": "alert", "data": {...}}``), the rest as bare predictions."""
    ts = F.date_format("created_at", ISO_MICROS)
    alert = F.to_json(
        F.struct(
            F.lit("alert").alias("type"),
            F.struct(
                F.col("kafka_key").alias("id"),
                F.col("predicted_attack").alias("attack_type"),
                "source_ip",
                "risk_score",
                "sensor_id",
                ts.alias("timestamp"),
            ).alias("data"),
        )
    )
    bare = F.to_json(
        F.struct(
            F.col("kafka_key").alias("id"),
            "predicted_attack",
            "source_ip",
            "confidence",
            "risk_score",
            F.col("model_name").alias("model_version"),
            ts.alias("timestamp"),
        )
    )
    return scored.select(
        F.col("kafka_key").alias("key"),
        F.when(F.col("risk_score") >= F.lit(float(threshold)), alert).otherwise(bare).alias("value"),
    )


# ---------------------------------------------------------------------------------------------
# Ingest requests
# ---------------------------------------------------------------------------------------------

_REQUEST = "struct<sensor_id:string,event_time:string,source_ip:string,destination_port:string," \
           "flow_duration:string,label:string,metadata:map<string,string>>"
_TZ_SUFFIX = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def ingest_requests(flows: DataFrame) -> DataFrame:
    """Ingest request bodies derived from flows (whole table, every row):
    ports and durations spread over and beyond the valid ranges, times with and
    without a zone suffix, half of the bodies wrapped in ``{"event": ...}``."""
    k = F.col("k")
    body = F.struct(
        F.col("sensor_id"),
        F.concat(F.date_format("kafka_timestamp", ISO_MICROS),
                 F.when(k % 2 == 0, F.lit("+02:00")).otherwise(F.lit(""))).alias("event_time"),
        F.col("source_ip"),
        (F.round(X.col("Flow Duration") * 2, 0).cast("bigint") - 3).alias("destination_port"),
        (k - 5).cast("bigint").alias("flow_duration"),
        F.col("Label").alias("label"),
    )
    wrapped = F.to_json(F.struct(body.alias("event")))
    return flows.select(
        F.col("kafka_key").alias("request_id"),
        F.when(X.col("Destination Port") % 2 == 0, wrapped).otherwise(F.to_json(body)).alias("body"),
    )


def validate_requests(requests: DataFrame, body_col: str = "body") -> DataFrame:
    """Apply the ingest rules; ``reject_reasons`` lists every broken rule.

    A body with an ``event`` key is unwrapped (a null ``event`` is rejected);
    a body without one is taken as the event itself. A zone suffix on the time
    is dropped without conversion.
    """
    b = F.col(body_col)
    # One parse of the top level; a nested object under "event" comes back as its JSON text.
    top = F.from_json(b, "map<string,string>", JSON_OPTS)
    event = F.try_element_at(top, F.lit("event"))
    has_event = F.coalesce(F.map_contains_key(top, F.lit("event")), F.lit(False))
    inner = F.when(has_event, event).otherwise(b)
    r = F.from_json(inner, _REQUEST, JSON_OPTS)
    staged = requests.select("*", r.alias("r"), has_event.alias("wrapped"), top.isNull().alias("_bad"),
                             (has_event & event.isNull()).alias("_no_event"))
    sensor, ip = F.col("r.sensor_id"), F.col("r.source_ip")
    port = F.col("r.destination_port").try_cast("bigint")
    dur = F.col("r.flow_duration").try_cast("bigint")
    et_text = F.regexp_replace(F.col("r.event_time"), _TZ_SUFFIX, "")
    et = F.try_to_timestamp(et_text)
    label = F.col("r.label")
    checks: list[tuple[Column, str]] = [
        (F.col("_bad"), "malformed body"),
        (F.col("_no_event"), "missing event payload"),
        (sensor.isNull(), "sensor_id required"),
        (F.length(sensor) < S.SENSOR_ID_LEN[0], "sensor_id too short"),
        (F.length(sensor) > S.SENSOR_ID_LEN[1], "sensor_id too long"),
        (F.col("r.event_time").isNull(), "event_time required"),
        (F.col("r.event_time").isNotNull() & et.isNull(), "event_time invalid"),
        (ip.isNull(), "source_ip required"),
        (F.length(ip) < S.SOURCE_IP_LEN[0], "source_ip too short"),
        (F.length(ip) > S.SOURCE_IP_LEN[1], "source_ip too long"),
        (F.col("r.destination_port").isNull(), "destination_port required"),
        (F.col("r.destination_port").isNotNull() & port.isNull(), "destination_port not an integer"),
        (port < S.PORT_RANGE[0], "destination_port below 0"),
        (port > S.PORT_RANGE[1], "destination_port above 65535"),
        (F.col("r.flow_duration").isNull(), "flow_duration required"),
        (F.col("r.flow_duration").isNotNull() & dur.isNull(), "flow_duration not an integer"),
        (dur < 0, "flow_duration below 0"),
        (F.length(label) > S.LABEL_MAX_LEN, "label too long"),
    ]
    reasons = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull()
    )
    return staged.select(
        *[c for c in requests.columns],
        "wrapped",
        sensor.alias("sensor_id"),
        et.alias("event_time"),
        ip.alias("source_ip"),
        port.try_cast("int").alias("destination_port"),
        dur.alias("flow_duration"),
        label.alias("label"),
        F.coalesce(F.col("r.metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
        reasons.alias("reject_reasons"),
    ).withColumn("valid", F.size("reject_reasons") == 0)

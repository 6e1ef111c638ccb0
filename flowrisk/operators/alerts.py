"""High-risk alerts: filter, payload, counters, recent list, key time, message
normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowrisk import schema as S
from flowrisk.functions import scalar as X


def is_high_risk(threshold: float = S.RISK_ALERT_THRESHOLD) -> Column:
    """The alert test: the *rounded* risk score reaches the threshold."""
    return F.col("risk_score") >= F.lit(float(threshold))


def high_risk(df: DataFrame, threshold: float = S.RISK_ALERT_THRESHOLD) -> DataFrame:
    """Rows whose *rounded* risk score reaches the threshold."""
    return df.filter(is_high_risk(threshold))


def to_alerts(
    scored: DataFrame,
    threshold: float = S.RISK_ALERT_THRESHOLD,
    ttl_seconds: int = S.ALERT_TTL_SECONDS,
    time_col: str = "created_at",
    key_col: str = "kafka_key",
) -> DataFrame:
    """One alert per high-risk prediction, keyed by the event key (alerts never
    overwrite each other), with its expiry time."""
    ts = F.col(time_col)
    return high_risk(scored, threshold).select(
        F.col(key_col).alias("alert_id"),
        F.col("predicted_attack").alias("attack_type"),
        "source_ip",
        "risk_score",
        "sensor_id",
        ts.alias("timestamp"),
        (ts + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def alert_payload(alerts: DataFrame) -> DataFrame:
    """JSON message body per alert (what is published to subscribers)."""
    body = F.struct("attack_type", "source_ip", "risk_score", "sensor_id", F.col("timestamp"))
    return alerts.select("alert_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def alert_counters(alerts: DataFrame) -> DataFrame:
    """Monotonic per-type counters (partial aggregation before the shuffle)."""
    return alerts.groupBy("attack_type").agg(F.count(F.lit(1)).alias("count"))


def total_alerts(counters: DataFrame, count_col: str = "count") -> DataFrame:
    """Sum of counters; values that do not parse as integers are skipped."""
    return counters.agg(F.coalesce(F.sum(F.col(count_col).try_cast("bigint")), F.lit(0)).cast("bigint").alias("total_alerts"))


def live_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    return alerts.filter(F.col("expires_at") > as_of)


def recent_alerts(alerts: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """Newest ``limit`` unexpired alerts (top-K: per-partition top-K, then merge)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be in 1..500")
    return live_alerts(alerts, as_of).orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(limit)


def alert_key_time(df: DataFrame, key_col: str, as_of: Column, prefix: str = S.ALERT_KEY_PREFIX) -> DataFrame:
    return df.withColumn("key_time", X.epoch_key_time(key_col, prefix, as_of))


_PAYLOAD = StructType(
    [
        StructField("id", StringType()),
        StructField("source_ip", StringType()),
        StructField("attack_type", StringType()),
        StructField("predicted_attack", StringType()),
        StructField("confidence", DoubleType()),
        StructField("risk_score", DoubleType()),
        StructField("model_version", StringType()),
        StructField("timestamp", StringType()),
    ]
)
_MESSAGE = StructType([StructField("type", StringType()), StructField("data", _PAYLOAD), *_PAYLOAD.fields])
CONTROL_TYPES = ("connected", "ping", "pong")
_NORMALIZED_ROWS = ("array<struct<id:string,source_ip:string,predicted_attack:string,confidence:double,"
                    "risk_score:double,model_version:string,timestamp:string,raw:string>>")


def normalize_alerts(messages: DataFrame, value_col: str = "value", keep_malformed: bool = False) -> DataFrame:
    """Live-feed messages -> alert rows.

    Control messages are dropped; ``{"type": "alert", "data": {...}}`` is
    unwrapped; missing fields get defaults. Malformed JSON is dropped, or with
    ``keep_malformed`` kept as a row whose ``raw`` column holds the text.

    Each message is parsed once: the parsed struct is computed in one
    projection and rows are kept or dropped by a generator over a 0/1-element
    array, so the parse is not duplicated into a pushed-down filter.
    """
    v = F.col(value_col)
    staged = messages.select(
        v.alias("_v"),
        F.from_json(v, _MESSAGE, {"mode": "PERMISSIVE"}).alias("_m"),
        F.from_json(v, "map<string,string>").isNull().alias("_bad"),
    )
    m = F.col("_m")
    p = F.when(m["type"] == "alert", m["data"]).otherwise(
        F.struct(*[m[f.name].alias(f.name) for f in _PAYLOAD.fields])
    )
    good = ~F.col("_bad")
    row = F.struct(
        F.when(good, p["id"]).alias("id"),
        F.when(good, F.coalesce(p["source_ip"], F.lit("0.0.0.0"))).alias("source_ip"),
        F.when(good, F.coalesce(p["attack_type"], p["predicted_attack"], F.lit(S.UNKNOWN_ATTACK))).alias(
            "predicted_attack"),
        F.when(good, F.coalesce(p["confidence"], F.lit(0.0))).alias("confidence"),
        F.when(good, F.coalesce(p["risk_score"], F.lit(0.0))).alias("risk_score"),
        F.when(good, p["model_version"]).alias("model_version"),
        F.when(good, p["timestamp"]).alias("timestamp"),
        F.when(~good, F.col("_v")).alias("raw"),
    )
    control = F.coalesce(m["type"].isin(*CONTROL_TYPES), F.lit(False))
    keep = ~control & (F.lit(True) if keep_malformed else good)
    return staged.select(F.inline(F.when(keep, F.array(row)).otherwise(F.array().cast(_NORMALIZED_ROWS))))

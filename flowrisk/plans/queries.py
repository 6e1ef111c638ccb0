"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (mostly ``events`` through the flow
adapter) over their whole extent; parameters are the defaults of the analysed
pipeline. Times are relative to ``as_of`` = newest event, fetched as one number when
the query is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.functions import scalar as X
from flowrisk.operators import alerts as AL
from flowrisk.operators import contract as CT
from flowrisk.operators import messages as MS
from flowrisk.operators import profiles as PR
from flowrisk.operators import quality as QL
from flowrisk.operators import stats as ST
from flowrisk.operators import tables as TB
from flowrisk.operators.enrich import with_severity
from flowrisk.sources import events as EV
from flowrisk.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

THRESHOLD = S.RISK_ALERT_THRESHOLD
PAGE_FILTER_ATTACK = "Botnet"
PAGE_FILTER_SOURCE = "10.0.38.1"


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def as_of_col(spark: SparkSession, sf_dir: str) -> Column:
    """Newest event time as a constant.

    One small aggregate (the ``ts`` column only) runs when the query is built
    and returns a single number (epoch microseconds, so no time-zone round trip
    through Python). As a literal, time-window filters against it fold to
    constants and reach the Parquet scan as pushed filters (row groups outside
    the window are skipped), which a scalar subquery cannot do.
    """
    micros = read_table(spark, sf_dir, "events").agg(
        F.unix_micros(F.max("ts").cast("timestamp")).alias("m")).first()["m"]
    return F.timestamp_micros(F.lit(micros))


# --- sources ---------------------------------------------------------------------------------


@register("scan_flows")
def q_scan_flows(spark, sf_dir):
    return EV.load_flows(spark, sf_dir)


@register("enrich_flows")
def q_enrich_flows(spark, sf_dir):
    return EV.load_flows(spark, sf_dir).select("kafka_key", "sensor_id", "event_time", "source_ip")


# --- scoring ---------------------------------------------------------------------------------


@register("decode_labels")
def q_decode_labels(spark, sf_dir):
    return EV.load_scored(spark, sf_dir).select("kafka_key", "prediction", "predicted_attack")


@register("risk_score")
def q_risk_score(spark, sf_dir):
    s = with_severity(EV.load_scored(spark, sf_dir))
    return s.select("kafka_key", "predicted_attack", "confidence", "severity", "risk_score")


@register("alerts")
def q_alerts(spark, sf_dir):
    return AL.to_alerts(EV.load_scored(spark, sf_dir), THRESHOLD)


# --- statistics ------------------------------------------------------------------------------


@register("attack_breakdown")
def q_attack_breakdown(spark, sf_dir):
    return ST.attack_breakdown(EV.load_scored(spark, sf_dir))


@register("stats_summary")
def q_stats_summary(spark, sf_dir):
    return ST.stats_summary(EV.load_scored(spark, sf_dir))


@register("top_ips")
def q_top_ips(spark, sf_dir):
    return ST.top_ips(EV.load_scored(spark, sf_dir), 10)


@register("timeline")
def q_timeline(spark, sf_dir):
    return ST.timeline(EV.load_scored(spark, sf_dir), as_of_col(spark, sf_dir), 24)


@register("alert_counters")
def q_alert_counters(spark, sf_dir):
    return AL.alert_counters(AL.to_alerts(EV.load_scored(spark, sf_dir), THRESHOLD))


@register("attack_share")
def q_attack_share(spark, sf_dir):
    return ST.attack_share(EV.load_scored(spark, sf_dir))


@register("top_ip_bars")
def q_top_ip_bars(spark, sf_dir):
    return ST.top_ip_bars(EV.load_scored(spark, sf_dir), 8)


@register("statistics")
def q_statistics(spark, sf_dir):
    return ST.statistics(EV.load_scored(spark, sf_dir), as_of_col(spark, sf_dir), THRESHOLD, 10, 24)


@register("statistics_rows")
def q_statistics_rows(spark, sf_dir):
    """The one-scan statistics document, unpacked into flat rows (oracle-checkable)."""
    doc = ST.statistics(EV.load_scored(spark, sf_dir), as_of_col(spark, sf_dir), THRESHOLD, 10, 24)
    return ST.statistics_rows(doc)


@register("batch_metrics")
def q_batch_metrics(spark, sf_dir):
    return ST.batch_metrics(EV.load_scored(spark, sf_dir), THRESHOLD)


# --- parse, messages, validation ----------------------------------------------------------

#: The whole flow record goes over the wire.
WIRE_FIELDS = [n for n, _ in S.FLOW_COLUMNS]
PROFILE_SPLIT = "2024-01-15 00:00:00"


@register("to_messages")
def q_to_messages(spark, sf_dir):
    return MS.to_messages(EV.load_flows(spark, sf_dir), WIRE_FIELDS)


@register("parse_events")
def q_parse_events(spark, sf_dir):
    return MS.parse_messages(MS.to_messages(EV.load_flows(spark, sf_dir), WIRE_FIELDS))


@register("verify_labels")
def q_verify_labels(spark, sf_dir):
    parsed = MS.parse_messages(MS.to_messages(EV.load_flows(spark, sf_dir), WIRE_FIELDS))
    return MS.label_histogram(parsed)


@register("validate_events")
def q_validate_events(spark, sf_dir):
    v = MS.validate_requests(MS.ingest_requests(EV.load_flows(spark, sf_dir)))
    return v.select(
        "request_id", "wrapped", "sensor_id", "event_time", "source_ip", "destination_port", "flow_duration",
        "label", F.array_join("reject_reasons", ";").alias("reject_reasons"), "valid",
    )


@register("normalize_alerts")
def q_normalize_alerts(spark, sf_dir):
    msgs = MS.live_messages(EV.load_scored(spark, sf_dir), THRESHOLD)
    return AL.normalize_alerts(msgs).drop("raw")


# --- stored tables, paging -----------------------------------------------------------------


@register("raw_telemetry")
def q_raw_telemetry(spark, sf_dir):
    return TB.raw_telemetry(EV.load_flows(spark, sf_dir))


@register("raw_upsert")
def q_raw_upsert(spark, sf_dir):
    return TB.raw_upsert(EV.load_flows(spark, sf_dir))


@register("recent_events")
def q_recent_events(spark, sf_dir):
    return TB.recent_events(TB.raw_upsert(EV.load_flows(spark, sf_dir)), "sensor-01", 100)


@register("prediction_docs")
def q_prediction_docs(spark, sf_dir):
    docs = TB.prediction_docs(EV.load_scored(spark, sf_dir))
    ev = docs.schema["event"].dataType.fieldNames()
    return docs.select(*[c for c in docs.columns if c != "event"],
                       *[F.col("event")[c].alias("event_" + c.replace(" ", "_").replace("/", "_")) for c in ev])


@register("predictions_page")
def q_predictions_page(spark, sf_dir):
    page = TB.predictions_page(EV.load_scored(spark, sf_dir), attack_type=PAGE_FILTER_ATTACK, page=2, page_size=20)
    return page.select("row_number", "kafka_key", "source_ip", "predicted_attack", "confidence", "risk_score",
                       "created_at")


@register("predictions_page_source")
def q_predictions_page_source(spark, sf_dir):
    """First page of one source address."""
    page = TB.predictions_page(EV.load_scored(spark, sf_dir), source_ip=PAGE_FILTER_SOURCE, page=1, page_size=20)
    return page.select("row_number", "kafka_key", "source_ip", "predicted_attack", "confidence", "risk_score",
                       "created_at")


@register("page_info")
def q_page_info(spark, sf_dir):
    return TB.page_info(EV.load_scored(spark, sf_dir), attack_type=PAGE_FILTER_ATTACK, page=2, page_size=20)


@register("recent_alerts")
def q_recent_alerts(spark, sf_dir):
    """Newest 50 live alerts. An alert expires TTL after it is raised, so only
    flows of the last TTL can hold one: that window (a superset; the exact
    expiry test still applies) reaches the scan as a pushed filter."""
    now = as_of_col(spark, sf_dir)
    recent = TB.retain(EV.load_scored(spark, sf_dir), "created_at", now, S.ALERT_TTL_SECONDS)
    return AL.recent_alerts(AL.to_alerts(recent, THRESHOLD, S.ALERT_TTL_SECONDS), now, 50)


@register("latest_alerts")
def q_latest_alerts(spark, sf_dir):
    """Newest 100 live alerts."""
    now = as_of_col(spark, sf_dir)
    recent = TB.retain(EV.load_scored(spark, sf_dir), "created_at", now, S.ALERT_TTL_SECONDS)
    return AL.recent_alerts(AL.to_alerts(recent, THRESHOLD, S.ALERT_TTL_SECONDS), now, 100)


@register("alert_payloads")
def q_alert_payloads(spark, sf_dir):
    return AL.alert_payload(AL.to_alerts(EV.load_scored(spark, sf_dir), THRESHOLD))


@register("alert_key_time")
def q_alert_key_time(spark, sf_dir):
    a = AL.to_alerts(EV.load_scored(spark, sf_dir), THRESHOLD)
    epoch = F.when(F.col("risk_score") >= 90, F.unix_millis("timestamp")).otherwise(F.unix_seconds("timestamp"))
    keyed = a.select("alert_id", F.concat(F.lit(S.ALERT_KEY_PREFIX), epoch.cast("string")).alias("alert_key"))
    return AL.alert_key_time(keyed, "alert_key", as_of_col(spark, sf_dir))


@register("retention")
def q_retention(spark, sf_dir):
    """Retention of the three stores fed by the scored flows (predictions,
    alerts = high-risk rows stamped at scoring time, topic), one scan."""
    return TB.retention_counts(EV.load_scored(spark, sf_dir), as_of_col(spark, sf_dir), [
        ("predictions", "created_at", S.PREDICTION_RETENTION_DAYS * 86400, None),
        ("alerts", "created_at", S.ALERT_TTL_SECONDS, AL.is_high_risk(THRESHOLD)),
        ("topic", "kafka_timestamp", S.TOPIC_RETENTION_HOURS * 3600, None),
    ])


# --- bands and small scalar functions ------------------------------------------------------


@register("severity_bands")
def q_severity_bands(spark, sf_dir):
    s = EV.load_scored(spark, sf_dir)
    return s.select("kafka_key", "risk_score", X.severity_band("risk_score").alias("severity_band"))


@register("confidence_bands")
def q_confidence_bands(spark, sf_dir):
    s = EV.load_scored(spark, sf_dir)
    return s.select(
        "kafka_key",
        X.normalize_confidence("confidence").alias("confidence"),
        X.confidence_band("confidence").alias("confidence_band"),
        X.confidence_percent("confidence").alias("confidence_percent"),
    )


@register("scalar_suite")
def q_scalar_suite(spark, sf_dir):
    s = EV.load_scored(spark, sf_dir)
    now = as_of_col(spark, sf_dir)
    return s.select(
        "kafka_key",
        X.hour_minute("created_at").alias("hh_mm"),
        X.age_seconds("created_at", now).alias("age_seconds"),
        F.trim(F.concat(F.lit("  "), F.col("source_ip"), F.lit(" "))).alias("ip_trimmed"),
        F.replace(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("Z"), F.lit("+00:00")).alias("iso_time"),
        F.regexp_replace(F.col("kafka_key"), r"^events\.parquet-", "").alias("key_suffix"),
        F.ceil(F.col("risk_score")).cast("bigint").alias("risk_ceil"),
    )


@register("confidence_array")
def q_confidence_array(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", X.max_of_array(F.col("embedding").cast("array<double>")).alias("confidence"))


# --- profiles ------------------------------------------------------------------------------


@register("attacker_profiles")
def q_attacker_profiles(spark, sf_dir):
    return PR.profiles_for_check(PR.batch_profiles(EV.load_scored(spark, sf_dir)))


@register("profile_merge")
def q_profile_merge(spark, sf_dir):
    s = EV.load_scored(spark, sf_dir)
    cut = F.lit(PROFILE_SPLIT).cast("timestamp")
    first = PR.batch_profiles(s.filter(F.col("created_at") < cut))
    second = PR.batch_profiles(s.filter(~(F.col("created_at") < cut)))
    return PR.profiles_for_check(PR.merge_profiles(first, second))


@register("breakdown_entries")
def q_breakdown_entries(spark, sf_dir):
    """Per-address counter maps turned into (attack_type, count) rows."""
    prof = PR.public_profiles(PR.batch_profiles(EV.load_scored(spark, sf_dir)))
    return prof.select("source_ip", F.inline(X.counts_as_entries("attack_counts")))


@register("latest_prediction")
def q_latest_prediction(spark, sf_dir):
    return PR.latest_prediction(EV.load_scored(spark, sf_dir))


# --- contract ------------------------------------------------------------------------------


@register("contract_profile")
def q_contract_profile(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    flows = EV.flows_from_events(ev, extra=[F.col("_metadata.file_path").alias("_file")])
    ncols = len(flows.columns) - 1
    return flows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(ncols).alias("column_count"),
        F.count_distinct("_file").alias("file_count"),
    )


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return CT.null_counts(EV.load_flows(spark, sf_dir))


@register("label_values")
def q_label_values(spark, sf_dir):
    return CT.label_values(EV.load_flows(spark, sf_dir))


@register("missing_features")
def q_missing_features(spark, sf_dir):
    return CT.missing_features(spark, EV.load_flows(spark, sf_dir))


@register("non_feature_columns")
def q_non_feature_columns(spark, sf_dir):
    return CT.non_feature_columns(spark, EV.load_flows(spark, sf_dir))


@register("contract_ok")
def q_contract_ok(spark, sf_dir):
    return CT.contract_ok(EV.load_flows(spark, sf_dir))


@register("contract_document")
def q_contract_document(spark, sf_dir):
    return _contract(spark, sf_dir)


def _contract(spark, sf_dir):
    flows = EV.flows_from_events(read_table(spark, sf_dir, "events"), extra=[F.col("_metadata.file_path").alias("_file")])
    return CT.contract_document(flows, source="events", file_col="_file")


@register("contract_summary")
def q_contract_summary(spark, sf_dir):
    """The contract document's fields that depend on the data, and the sizes of its lists."""
    return _contract(spark, sf_dir).select(
        "source", "file_count", "row_count", F.col("column_count").cast("bigint").alias("column_count"),
        F.array_join("label_values", ",").alias("label_values"),
        F.aggregate(F.map_values("null_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("nulls"),
        F.aggregate(F.map_values("critical_field_nulls"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("critical_nulls"),
        F.size("missing_selected_features").cast("bigint").alias("missing"),
        F.size("non_feature_columns").cast("bigint").alias("non_features"),
        "contract_ok",
    )


@register("schema_diff")
def q_schema_diff(spark, sf_dir):
    return CT.schema_diff(spark, EV.load_flows(spark, sf_dir))


# --- classification quality (on the adapter's predictions) ---------------------------------


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    s = EV.load_scored(spark, sf_dir)
    return s.groupBy(F.col("Label").alias("actual"), F.col("predicted_attack").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


@register("weighted_f1")
def q_weighted_f1(spark, sf_dir):
    return QL.weighted_f1(EV.load_scored(spark, sf_dir), "Label", "predicted_attack")


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)

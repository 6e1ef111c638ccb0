import json

from pyspark.sql import functions as F

from flowrisk.operators import alerts as AL


def test_normalize_messages(spark):
    msgs = [
        {"type": "connected"},
        {"type": "ping"},
        {"type": "pong"},
        {"type": "alert", "data": {"attack_type": "Botnet", "source_ip": "10.0.1.1", "risk_score": 91.2,
                                   "timestamp": "2024-01-01T00:00:00"}},
        {"predicted_attack": "Recon", "source_ip": "10.0.2.1", "confidence": 0.8, "risk_score": 72.0},
        "{not json",
        {},
    ]
    df = spark.createDataFrame([(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(msgs)],
                               "n int, value string")
    out = AL.normalize_alerts(df).collect()
    assert len(out) == 3
    wrapped, bare, empty = out
    assert (wrapped.predicted_attack, wrapped.risk_score, wrapped.confidence) == ("Botnet", 91.2, 0.0)
    assert (bare.predicted_attack, bare.confidence) == ("Recon", 0.8)
    assert (empty.source_ip, empty.predicted_attack, empty.risk_score) == ("0.0.0.0", "Unknown", 0.0)
    kept = AL.normalize_alerts(df, keep_malformed=True).filter(F.col("raw").isNotNull()).collect()
    assert [r.raw for r in kept] == ["{not json"]


def test_alert_keys_and_expiry(spark):
    rows = [
        ("e1", "Botnet", "10.0.1.1", 90.0, "s", "2024-01-01 10:00:00.001"),
        ("e2", "Botnet", "10.0.1.1", 85.0, "s", "2024-01-01 10:00:00.001"),  # same millisecond: both kept
        ("e3", "Recon", "10.0.2.1", 81.0, "s", "2024-01-01 08:00:00"),  # expired at as_of
        ("e4", "Normal", "10.0.3.1", 20.0, "s", "2024-01-01 10:30:00"),  # below threshold
    ]
    df = spark.createDataFrame(rows, "kafka_key string, predicted_attack string, source_ip string, risk_score double, "
                                     "sensor_id string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    alerts = AL.to_alerts(df, 80.0, 3600)
    assert alerts.count() == 3
    as_of = F.lit("2024-01-01 10:45:00").cast("timestamp")
    recent = AL.recent_alerts(alerts, as_of, 50).collect()
    assert [r.alert_id for r in recent] == ["e2", "e1"]
    counters = {r[0]: r[1] for r in AL.alert_counters(alerts).collect()}
    assert counters == {"Botnet": 2, "Recon": 1}
    total = spark.createDataFrame([("3",), ("x",), ("4",)], "count string")
    assert AL.total_alerts(total).first()[0] == 7
    payload = json.loads(AL.alert_payload(alerts).filter("alert_id = 'e1'").first().payload)
    assert payload["attack_type"] == "Botnet" and payload["risk_score"] == 90.0

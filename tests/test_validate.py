import json

from flowrisk.operators.messages import validate_requests


def body(**kw):
    base = {"sensor_id": "s1", "event_time": "2024-01-01T10:00:00", "source_ip": "10.0.1.1",
            "destination_port": 80, "flow_duration": 5, "label": "Botnet"}
    base.update(kw)
    return base


def run(spark, bodies):
    rows = [(str(i), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "request_id string, body string")
    return {r["request_id"]: r for r in validate_requests(df).collect()}


def test_rules(spark):
    cases = [
        body(),
        body(sensor_id=""),
        body(sensor_id="x" * 129),
        body(source_ip="1.2.3."),
        body(source_ip="1" * 46),
        body(destination_port=-1),
        body(destination_port=0),
        body(destination_port=65535),
        body(destination_port=65536),
        body(flow_duration=-1),
        body(label="L" * 65),
        body(event_time="2024-01-01T10:00:00+02:00"),
        {"event": body()},
        {"event": None},
        "{bad",
        {"sensor_id": "s1"},
    ]
    r = run(spark, cases)
    ok = lambda i: r[str(i)]["valid"]
    reasons = lambda i: r[str(i)]["reject_reasons"]
    assert ok(0) and ok(6) and ok(7) and ok(11) and ok(12)
    assert reasons(1) == ["sensor_id too short"]
    assert reasons(2) == ["sensor_id too long"]
    assert reasons(3) == ["source_ip too short"]
    assert reasons(4) == ["source_ip too long"]
    assert reasons(5) == ["destination_port below 0"]
    assert reasons(8) == ["destination_port above 65535"]
    assert reasons(9) == ["flow_duration below 0"]
    assert reasons(10) == ["label too long"]
    # the zone is dropped without converting the wall-clock time
    assert r["11"]["event_time"].isoformat() == "2024-01-01T10:00:00"
    assert r["12"]["wrapped"] is True
    assert "missing event payload" in reasons(13)
    assert "malformed body" in reasons(14)
    assert set(reasons(15)) >= {"event_time required", "source_ip required", "destination_port required",
                                "flow_duration required"}


def test_huge_ports_and_keys_do_not_abort(spark):
    from pyspark.sql import functions as F

    from flowrisk.operators import alerts as AL
    from flowrisk.operators import messages as MS

    body = '{"sensor_id": "s", "event_time": "2024-01-01T00:00:00", "source_ip": "10.0.0.1", "destination_port": %s, "flow_duration": 1}'
    req = spark.createDataFrame([(p, body % p) for p in ("5000000000", "80", "-5000000000")], "id string, body string")
    got = {r["id"]: r for r in MS.validate_requests(req).collect()}
    assert got["80"]["valid"]
    assert got["5000000000"]["reject_reasons"] == ["destination_port above 65535"]
    assert got["-5000000000"]["reject_reasons"] == ["destination_port below 0"]
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    keys = spark.createDataFrame([("alert:9223372036854775807",), ("alert:-9223372036854775808",), ("alert:1700000000",)], "alert_key string")
    times = [r["key_time"].year for r in AL.alert_key_time(keys, "alert_key", now).collect()]
    assert times == [2024, 2024, 2023]

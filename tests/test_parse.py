from pyspark.sql import functions as F

from flowrisk.operators.messages import label_histogram, parse_messages, to_messages
from flowrisk.schema import FLOW_SCHEMA


def msgs(spark, values):
    rows = [(f"k{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, value string").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_permissive_parse(spark):
    values = [
        '{"Destination Port": 80, "Flow Bytes/s": NaN, "Flow Packets/s": Infinity, "Label": "DoS/DDoS"}',
        '{"Destination Port": 99999999999, "Flow Duration": 5}',
        "{bad",
        '{"Destination Port": 80.0, "Label": 7}',
        '{"Flow Duration": null}',
        "{}",
    ]
    out = parse_messages(msgs(spark, values)).orderBy("kafka_key").collect()
    assert len(out) == 6 and len(out[0]) == 2 + len(FLOW_SCHEMA.fields) + 1
    a, b, c, d, e, f = out
    assert a["Destination Port"] == 80 and a["Label"] == "DoS/DDoS"
    assert a["Flow Bytes/s"] != a["Flow Bytes/s"]  # NaN survives
    assert a["Flow Packets/s"] == float("inf")
    assert b["Destination Port"] is None  # out of int range -> null field
    assert c["is_corrupt"] is True and c["Destination Port"] is None and c["Label"] is None
    assert d["Destination Port"] is None  # 80.0 is not an int
    assert d["Label"] == "7"  # number for a string keeps its text
    assert e["Flow Duration"] is None and e["is_corrupt"] is False
    assert f["Label"] is None


def test_round_trip_and_histogram(spark):
    df = spark.createDataFrame([("a", 80, 10, "Botnet"), ("b", 443, None, None)],
                               "kafka_key string, `Destination Port` int, `Flow Duration` int, Label string")
    df = df.withColumn("kafka_timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    m = to_messages(df, ["Destination Port", "Flow Duration", "Label"])
    vals = {r["key"]: r["value"] for r in m.collect()}
    assert vals["b"] == '{"Destination Port":443,"Flow Duration":null,"Label":null}'
    back = parse_messages(m)
    assert back.filter("kafka_key = 'a'").first()["Destination Port"] == 80
    h = {r["label"]: r["count"] for r in label_histogram(back).collect()}
    assert h == {"Botnet": 1, "UNKNOWN": 1}
    assert to_messages(df, ["Label"], max_rows=1).count() == 1


def test_bounded_label_read(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "key string, Label string")
    assert sum(r["count"] for r in label_histogram(df, max_messages=2).collect()) == 2
    assert sum(r["count"] for r in label_histogram(df, max_messages=0).collect()) == 3

from pyspark.sql import functions as F

from flowrisk.functions import scalar as X


def one(spark, expr, schema="x double", rows=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr).collect()]


def test_source_ip_from_port(spark):
    df = spark.createDataFrame([(80,), (None,), (-3,), (249,), (250,)], "p int")
    got = [r[0] for r in df.select(X.source_ip_from_port("p")).collect()]
    assert got == ["10.0.81.1", None, "10.0.-2.1", "10.0.250.1", "10.0.1.1"]
    got = [r[0] for r in df.select(X.source_ip_from_port("p", positive_mod=True)).collect()]
    assert got[2] == "10.0.248.1"


def test_severity_default_and_table(spark):
    df = spark.createDataFrame([("Botnet",), ("Normal",), ("Nope",), (None,)], "a string")
    assert [r[0] for r in df.select(X.severity("a")).collect()] == [85, 5, 50, 50]


def test_risk_score_rounding_and_threshold(spark):
    rows = [(0.766584, "Botnet"), (0.766583, "Botnet"), (0.999985, "Recon"), (1.0, "DoS/DDoS"), (None, "Normal"),
            (0.5, "Unknown")]
    df = spark.createDataFrame(rows, "c double, a string")
    got = [r[0] for r in df.select(X.risk_score("c", "a")).collect()]
    # the rounded score decides alerts: 79.99504 -> 80.0 alerts, 79.99498 -> 79.99 does not
    assert got == [80.0, 79.99, 84.0, 98.0, 2.0, 50.0]
    assert max(got) <= 98.0


def test_decode_label_bounds(spark):
    labels = ["A", "B", "C"]
    df = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (-1.0,), (1.5,), (None,)], "i double")
    assert [r[0] for r in df.select(X.decode_label("i", labels)).collect()] == ["A", "C", "Unknown", "Unknown",
                                                                              "Unknown", "Unknown"]


def test_bands(spark):
    df = spark.createDataFrame([(95.0,), (90.0,), (85.0,), (80.0,), (51.0,), (50.0,)], "r double")
    assert [r[0] for r in df.select(X.severity_band("r")).collect()] == ["critical", "high", "high", "medium",
                                                                       "medium", "low"]
    df = spark.createDataFrame([(0.95,), (85.0,), (0.7,), (0.69,), (None,)], "c double")
    got = df.select(X.confidence_band("c"), X.confidence_percent("c")).collect()
    assert [r[0] for r in got] == ["high", "medium", "medium", "low", None]
    assert [r[1] for r in got] == [95.0, 85.0, 70.0, 69.0, None]


def test_epoch_key_time(spark):
    df = spark.createDataFrame([("alert:1716123456789",), ("alert:1716123456",), ("alert:abc",)], "k string")
    fb = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = [r[0] for r in df.select(X.epoch_key_time("k", "alert:", fb)).collect()]
    assert got[0].isoformat() == "2024-05-19T12:57:36.789000"
    assert got[1].isoformat() == "2024-05-19T12:57:36"
    assert got[2].isoformat() == "2024-01-01T00:00:00"


def test_column_names_with_spaces_and_slashes(spark):
    df = spark.createDataFrame([(1.5,)], "`Flow Bytes/s` double")
    assert df.select(X.col("Flow Bytes/s")).first()[0] == 1.5

"""Adapter numbers at sf0.01 must equal the published expectations."""

from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from flowrisk.operators import alerts as AL
from flowrisk.sources import events as EV


def test_adapter_counts(spark):
    s = EV.load_scored(spark, SF_CHECK)
    pred = {r[0]: r[1] for r in s.groupBy("predicted_attack").count().collect()}
    assert pred == {"Normal": 1929, "Recon": 1898, "Botnet": 1882, "DoS/DDoS": 1879, "WebAttack": 1857,
                    "Unknown": 555}
    assert s.filter(F.col("predicted_attack") != F.col("Label")).count() == 1442
    rng = s.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert (rng[0], rng[1]) == (32.48, 97.88)
    alerts = AL.to_alerts(s, 80.0)
    by = {r[0]: r[1] for r in AL.alert_counters(alerts).collect()}
    assert by == {"DoS/DDoS": 1084, "Botnet": 855, "WebAttack": 480, "Recon": 260}
    assert sum(by.values()) == 2679


def test_event_time_key_collisions(spark):
    f = EV.load_flows(spark, SF_CHECK)
    assert f.select("sensor_id", "event_time").distinct().count() == 9654
    assert f.select("source_ip").distinct().count() == 150


def test_adapter_plans_have_no_shuffle_and_see_new_columns(spark, tmp_path):
    plan = EV.load_flows(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    from flowrisk.sources.tables import read_table

    one = spark.range(3).selectExpr("id as a")
    one.write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").columns == ["a"]
    one.selectExpr("a", "a as b").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").columns == ["a", "b"]

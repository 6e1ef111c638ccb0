from pyspark.sql import functions as F

from flowrisk.operators import profiles as PR


def preds(spark, rows):
    return spark.createDataFrame(rows, "kafka_key string, source_ip string, predicted_attack string, risk_score double, "
                                       "sensor_id string, created_at string").select(
        "*", F.col("created_at").cast("timestamp").alias("ts")).drop("created_at").withColumnRenamed(
        "ts", "created_at").withColumn("event_time", F.col("created_at"))


def test_merge_equals_union(spark):
    a = preds(spark, [("k1", "ip1", "Botnet", 90.0, "s1", "2024-01-01 00:00:00"),
                      ("k2", "ip1", "Recon", 60.0, "s1", "2024-01-01 00:01:00"),
                      ("k3", "ip2", "Normal", 10.0, "s2", "2024-01-01 00:02:00")])
    b = preds(spark, [("k4", "ip1", "Botnet", 70.0, "s3", "2024-01-02 00:00:00"),
                      ("k5", "ip3", "DoS/DDoS", 95.0, "s1", "2024-01-02 00:00:00")])
    merged = PR.profiles_for_check(PR.merge_profiles(PR.batch_profiles(a), PR.batch_profiles(b)))
    whole = PR.profiles_for_check(PR.batch_profiles(a.unionByName(b)))
    assert sorted(merged.collect()) == sorted(whole.collect())
    ip1 = merged.filter("source_ip = 'ip1'").first()
    assert ip1.event_count == 3 and ip1.attack_counts == "Botnet=2,Recon=1"
    assert ip1.latest_attack == "Botnet" and ip1.risk_score == 70.0 and ip1.sensor_id == "s3"
    assert ip1.peak_risk_score == 90.0


def test_equal_timestamps_break_ties_by_key(spark):
    p = preds(spark, [("k1", "ip1", "Botnet", 90.0, "s1", "2024-01-01 00:00:00"),
                      ("k2", "ip1", "Recon", 60.0, "s1", "2024-01-01 00:00:00")])
    r = PR.public_profiles(PR.batch_profiles(p)).first()
    assert r.latest_attack == "Recon"  # larger key wins on equal times
    counts = PR.batch_profiles(p).select(F.aggregate(F.map_values("attack_counts"), F.lit(0).cast("bigint"),
                                                     lambda acc, x: acc + x).alias("s"), "event_count").first()
    assert counts.s == counts.event_count

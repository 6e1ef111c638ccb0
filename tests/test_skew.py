"""A third of all rows on one source address: statistics, profiles and the
latest prediction stay exact (checked against pandas on the small fixture)."""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from flowrisk.operators import profiles as PR
from flowrisk.operators import stats as ST
from flowrisk.plans.queries import as_of_col
from flowrisk.sources import events as EV

HOT = "10.0.250.1"


def skewed(spark):
    s = EV.load_scored(spark, SF_CHECK)
    # test fixture only: every row whose k is below 34 (about a third) moves to one address
    return s.withColumn("source_ip", F.when(F.col("k") < 34, F.lit(HOT)).otherwise(F.col("source_ip")))


def test_hot_address_statistics_and_profiles(spark):
    s = skewed(spark)
    pdf = s.select("kafka_key", "source_ip", "predicted_attack", "risk_score", "created_at", "event_time").toPandas()
    share = (pdf.source_ip == HOT).mean()
    assert 0.3 < share < 0.4

    doc = ST.statistics(s, as_of_col(spark, SF_CHECK), 80.0, 10, 24).first()
    by_ip = pdf.groupby("source_ip").size().reset_index(name="n").sort_values(["n", "source_ip"],
                                                                               ascending=[False, True])
    assert [(x.source_ip, x["count"]) for x in doc.top_ips] == list(by_ip.head(10).itertuples(index=False, name=None))
    assert doc.top_ips[0].source_ip == HOT
    assert doc.total_alerts == int((pdf.risk_score >= 80.0).sum())

    prof = PR.public_profiles(PR.batch_profiles(s)).filter(F.col("source_ip") == HOT).first()
    hot = pdf[pdf.source_ip == HOT]
    assert prof.event_count == len(hot)
    assert dict(prof.attack_counts) == hot.groupby("predicted_attack").size().to_dict()
    assert prof.peak_risk_score == hot.risk_score.max()
    last = hot.sort_values(["created_at", "event_time", "kafka_key"]).iloc[-1]
    assert (prof.latest_attack, prof.risk_score) == (last.predicted_attack, last.risk_score)

    latest = PR.latest_prediction(s).filter(F.col("source_ip") == HOT).first()
    assert latest.kafka_key == last.kafka_key

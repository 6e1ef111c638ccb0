"""The one-scan statistics document equals its parts computed separately."""

from conftest import SF_CHECK
from flowrisk.operators import alerts as AL
from flowrisk.operators import stats as ST
from flowrisk.plans.queries import as_of_col
from flowrisk.sources import events as EV


def test_statistics_document_matches_parts(spark):
    preds = EV.load_scored(spark, SF_CHECK)
    now = as_of_col(spark, SF_CHECK)
    doc = ST.statistics(preds, now, 80.0, 10, 24).first()
    breakdown = [(r.attack_type, r["count"]) for r in ST.attack_breakdown(preds).collect()]
    assert [(x.attack_type, x["count"]) for x in doc.attack_breakdown] == breakdown
    assert doc.total_predictions == sum(c for _, c in breakdown) == 10000
    assert doc.top_attack == breakdown[0][0]
    assert [(x.source_ip, x["count"]) for x in doc.top_ips] == [(r.source_ip, r["count"])
                                                               for r in ST.top_ips(preds, 10).collect()]
    assert [(x.timestamp, x["count"]) for x in doc.timeline] == [(r.timestamp, r["count"])
                                                                 for r in ST.timeline(preds, now, 24).collect()]
    assert doc.total_alerts == AL.to_alerts(preds, 80.0).count() == 2679

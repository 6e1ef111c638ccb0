"""Property tests: risk bounds and exact rounding, associative profile merge,
keyed upsert against a brute-force last-write-wins."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.functions import scalar as X
from flowrisk.operators import profiles as PR
from flowrisk.operators import tables as TB

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
ATTACKS = sorted(S.SEVERITY_BY_ATTACK) + ["Unseen"]
IPS = ["10.0.1.1", "10.0.2.1", "10.0.3.1"]


def expected_risk(conf_milli, attack):
    conf = Decimal(conf_milli or 0) / 1000
    sev = Decimal(S.SEVERITY_BY_ATTACK.get(attack, S.DEFAULT_SEVERITY))
    raw = min(Decimal(100), conf * 100 * Decimal("0.6") + sev * Decimal("0.4"))
    return float(raw.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 1000)), st.sampled_from(ATTACKS)), min_size=1,
                max_size=40))
def test_risk_in_bounds_and_half_up(spark, rows):
    df = spark.createDataFrame([(None if c is None else c / 1000, a) for c, a in rows],
                               "confidence double, predicted_attack string")
    got = [r.risk for r in df.select(X.risk_score("confidence", "predicted_attack").alias("risk")).collect()]
    want = [expected_risk(c, a) for c, a in rows]
    assert got == want
    assert all(0.0 <= r <= 98.0 for r in got)


def _pred_rows(draw_rows):
    return [(f"k{i:03d}", ip, attack, float(risk), f"s{sensor}", f"2024-01-01 00:{minute:02d}:00")
            for i, (ip, attack, risk, sensor, minute) in enumerate(draw_rows)]


PRED_ROW = st.tuples(st.sampled_from(IPS), st.sampled_from(ATTACKS), st.integers(0, 98), st.integers(1, 3),
                     st.integers(0, 5))


def _preds(spark, rows):
    return spark.createDataFrame(rows, "kafka_key string, source_ip string, predicted_attack string, "
                                       "risk_score double, sensor_id string, t string").select(
        "kafka_key", "source_ip", "predicted_attack", "risk_score", "sensor_id",
        F.col("t").cast("timestamp").alias("created_at"), F.col("t").cast("timestamp").alias("event_time"))


@SETTINGS
@given(st.lists(PRED_ROW, min_size=1, max_size=30), st.integers(1, 4))
def test_merge_of_batches_equals_profile_of_union(spark, rows, parts):
    data = _pred_rows(rows)
    batches = [data[i::parts] for i in range(parts)]
    deltas = [PR.batch_profiles(_preds(spark, b)) for b in batches if b]
    merged = PR.profiles_for_check(PR.merge_profiles(*deltas)).collect()
    whole = PR.profiles_for_check(PR.batch_profiles(_preds(spark, data))).collect()
    assert sorted(merged) == sorted(whole)
    # brute force: counts and peaks per address
    for r in whole:
        mine = [d for d in data if d[1] == r.source_ip]
        assert r.event_count == len(mine)
        assert r.peak_risk_score == max(d[3] for d in mine)
        counts = {}
        for d in mine:
            counts[d[2]] = counts.get(d[2], 0) + 1
        assert r.attack_counts == ",".join(f"{k}={v}" for k, v in sorted(counts.items()))
        latest = max(mine, key=lambda d: (d[5], d[5], d[0]))
        assert (r.latest_attack, r.risk_score, r.sensor_id) == (latest[2], latest[3], latest[4])


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(0, 3), st.integers(0, 5), st.integers(0, 99)), min_size=1,
                max_size=40))
def test_keyed_upsert_is_last_write_wins(spark, rows):
    data = [(f"s{s}", t, arrival, f"k{i:03d}", v) for i, (s, t, arrival, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "sensor string, t int, arrival int, key string, v int")
    got = sorted(tuple(r) for r in TB.keyed_upsert(df, ["sensor", "t"], ["arrival", "key"]).select(
        "sensor", "t", "arrival", "key", "v").collect())
    best = {}
    for row in data:
        k = row[:2]
        if k not in best or (row[2], row[3]) > (best[k][2], best[k][3]):
            best[k] = row
    assert got == sorted(best.values())

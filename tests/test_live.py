"""Aggregates kept live: profiles on the state store across restarts and replays; timeline with late rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowrisk.operators import profiles as PR
from flowrisk.plans import jobs as J
from flowrisk.session import scratch_path
from flowrisk.sources import events as EV
from flowrisk.streaming import live as SL

CELL = "source_ip string, predicted_attack string, risk_score double, sensor_id string, created_at timestamp, event_time timestamp, kafka_key string"


def rows(df):
    return sorted(map(str, df.collect()))


def test_profiles_after_a_restart_equal_the_batch(spark):
    sinks = J.run_live_profiles(spark, SF_SMALL)
    scored = EV.score_wire_flows(EV.load_flows(spark, SF_SMALL).withColumn("sensor_id", F.lit("sensor-01")).withColumn("event_time", F.col("kafka_timestamp")))
    want = PR.batch_profiles(scored.withColumn("created_at", F.col("kafka_timestamp")))
    assert rows(PR.profiles_for_check(sinks.read(spark))) == rows(PR.profiles_for_check(want))
    log = sinks.commits(spark)
    assert log.last() >= 4 and any(level for level, *_ in log.segments("states"))
    # an update holds changed keys only, and a batch that is handed over again adds nothing
    before = rows(sinks.read(spark))
    again = PR.profile_cells(scored.withColumn("created_at", F.col("kafka_timestamp")))
    state = log.log.newest()[1]
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", state["stream"])
    try:
        sinks(again, state["batch_id"])
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert rows(sinks.read(spark)) == before and log.last() == state["epoch_id"]


def test_newest_state_wins_over_merges(spark):
    sinks = SL.ProfileStates(scratch_path(spark, "t-states"), fanout=2, grace=1)
    for n in range(1, 8):
        data = [("a", "Recon", 1.0 * i, "s", f"2024-01-01 00:00:{i:02}", f"2024-01-01 00:00:{i:02}", f"k{i}") for i in range(n)]
        data += [(None, "Normal", 5.0, "s", "2024-01-01 00:00:00", None, None)] if n == 2 else []
        df = spark.createDataFrame(data, CELL.replace("timestamp", "string"))
        cells = PR.profile_cells(df.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("event_time", F.col("event_time").cast("timestamp")))
        sinks(cells, n)
    got = {r["source_ip"]: r for r in sinks.read(spark).collect()}
    assert got["a"]["event_count"] == 7 and got["a"]["peak_risk_score"] == 6.0 and got["a"]["attack_counts"] == {"Recon": 7}
    assert got[None]["event_count"] == 1


def frame(spark, times):
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(times)], "kafka_key string, t string").select("kafka_key", F.col("t").cast("timestamp").alias("created_at"))


def counts(df):
    return {r["timestamp"].strftime("%d %H"): r["count"] for r in df.collect()}


def test_late_rows_go_to_their_table(spark):
    sink = SL.Timeline(scratch_path(spark, "t-timeline"), 2 * 3600 * 10**6, fanout=2, grace=1)
    sink(frame(spark, ["2024-01-01 09:10:00", "2024-01-01 10:20:00", None]), 0)
    sink(frame(spark, ["2024-01-01 07:00:00", "2024-01-01 08:10:00", "2024-01-01 12:30:00"]), 1)  # watermark 08:20
    assert counts(sink.read(spark)) == {"01 08": 1, "01 09": 1, "01 10": 1, "01 12": 1}
    assert [r["kafka_key"] for r in sink.late(spark).collect()] == ["k0"]
    assert sink.commits(spark).log.newest()[1]["late_rows"] == 1
    sink(frame(spark, []), 2)
    sink(frame(spark, ["2024-01-01 09:59:59", "2024-01-01 10:00:00"]), 3)  # watermark 10:30: hour 9 has ended, hour 10 not
    assert counts(sink.read(spark)) == {"01 08": 1, "01 09": 1, "01 10": 2, "01 12": 1}
    assert sink.late(spark).count() == 2
    as_of = F.lit("2024-01-01 12:40:00").cast("timestamp")
    assert counts(sink.read(spark, as_of, hours=2)) == {"01 10": 2, "01 12": 1}
    # a batch that comes again after its commit changes nothing
    sink(frame(spark, ["2024-01-01 12:00:00"]), 3)
    assert sum(counts(sink.read(spark)).values()) == 5 and sink.late(spark).count() == 2


def test_aborted_epoch_is_split_alike_when_it_is_tried_again(spark, monkeypatch):
    from flowrisk.streaming.commits import Commits

    sink = SL.Timeline(scratch_path(spark, "t-abort"), 3600 * 10**6)
    sink(frame(spark, ["2024-01-01 10:00:00"]), 0)
    batch = frame(spark, ["2024-01-01 07:00:00", "2024-01-01 20:00:00", "2024-01-01 09:30:00"])
    commit = Commits.commit
    monkeypatch.setattr(Commits, "commit", lambda *a, **k: 1 / 0)
    try:
        sink(batch, 1)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(Commits, "commit", commit)
    assert counts(sink.read(spark)) == {"01 10": 1} and sink.late(spark).count() == 0  # nothing of it is seen
    sink(batch, 1)
    assert counts(sink.read(spark)) == {"01 09": 1, "01 10": 1, "01 20": 1} and sink.late(spark).count() == 1


def test_timeline_of_the_stream_and_its_late_rows_are_all_rows(spark):
    sink = J.run_timeline(spark, SF_SMALL)
    late = sink.late(spark)
    flows = EV.load_flows(spark, SF_SMALL)
    batch = flows.groupBy(F.date_trunc("hour", "kafka_timestamp").alias("timestamp")).agg(F.count(F.lit(1)).alias("count"))
    rest = late.groupBy(F.date_trunc("hour", "kafka_timestamp").alias("timestamp")).agg(F.count(F.lit(1)).alias("count"))
    both = SL._summed(sink.read(spark).unionByName(rest))
    assert rows(both.select("timestamp", "count")) == rows(batch)
    held = flows.filter(F.col("k") % 20 == 7).count()
    assert 0 < late.count() < held
    assert sink.commits(spark).last() >= 4

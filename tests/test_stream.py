"""Streaming job: stream = batch, restart from checkpoint, idempotent replay,
statistics freshness, reset."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowrisk.operators.enrich import score_predictions
from flowrisk.operators import alerts as AL
from flowrisk.operators import profiles as PR
from flowrisk.operators import stats as ST
from flowrisk.operators.messages import to_messages
from flowrisk.session import scratch_path
from flowrisk.sources import events as EV
from flowrisk.streaming import pipeline as SP

WIRE = ["Destination Port", "Flow Duration", "Label"]
LABELS = ["Normal", "Recon", "WebAttack", "Botnet", "DoS/DDoS"]


def scorer(df):
    """Deterministic stand-in classifier on the parsed flow fields."""
    staged = df.withColumn("prediction", (F.col("`Destination Port`") % 6).cast("double")).withColumn(
        "conf", ((F.col("`Flow Duration`") % 500) + 500) / 1000.0)
    return score_predictions(staged, LABELS, "test_model", confidence_col="conf", probability_col=None).drop("conf")


def write_parts(spark, root, parts=3):
    msgs = to_messages(EV.load_flows(spark, SF_SMALL), WIRE)
    n = msgs.count()
    ordered = msgs.orderBy("timestamp").collect()
    step = (n + parts - 1) // parts
    for i in range(parts):
        chunk = ordered[i * step:(i + 1) * step]
        spark.createDataFrame(chunk, msgs.schema).coalesce(1).write.mode("append").parquet(f"{root}/source")
    return n


def run(spark, root, sinks):
    stream = SP.file_stream(spark, f"{root}/source", max_files_per_trigger=1)
    q = SP.start(SP.parsed_flows(stream), SP.BatchProcessor(sinks, scorer), f"{root}/checkpoint", available_now=True)
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_and_restart(spark):
    root = scratch_path(spark, "t-stream")
    n = write_parts(spark, root, parts=3)
    sinks = SP.Sinks(f"{root}/tables")
    run(spark, root, sinks)
    preds = spark.read.parquet(sinks.predictions)
    assert preds.count() == n
    assert preds.select("epoch_id").distinct().count() == 3
    batch = scorer(SP.parsed_flows(spark.read.parquet(f"{root}/source"))).select("kafka_key", "risk_score",
                                                                                 "predicted_attack")
    stream = preds.select("kafka_key", "risk_score", "predicted_attack")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0
    # restart: only the new file is processed, nothing is reprocessed
    extra = to_messages(EV.load_flows(spark, SF_SMALL), WIRE).withColumn(
        "key", F.concat(F.col("key"), F.lit("-late")))
    extra.limit(10).coalesce(1).write.mode("append").parquet(f"{root}/source")
    run(spark, root, sinks)
    assert spark.read.parquet(sinks.predictions).count() == n + 10
    # profiles are exact: their counts add up to all predictions
    prof = SP.read_profiles(spark, sinks)
    assert prof.agg(F.sum("event_count")).first()[0] == n + 10
    raw = SP.read_raw(spark, sinks)
    assert raw.count() == raw.select("sensor_id", "event_time").distinct().count()


def test_replayed_epoch_is_idempotent(spark):
    root = scratch_path(spark, "t-replay")
    sinks = SP.Sinks(f"{root}/tables")
    proc = SP.BatchProcessor(sinks, scorer)
    batch = SP.parsed_flows(to_messages(EV.load_flows(spark, SF_SMALL), WIRE))
    proc(batch, 0)
    proc(batch, 0)  # a retry of the same epoch
    proc(batch.limit(0), 1)  # an empty batch writes nothing
    n = batch.count()
    assert spark.read.parquet(sinks.predictions).count() == n
    alerts = spark.read.parquet(sinks.alerts).count()
    counters = SP.read_alert_counters(spark, sinks).agg(F.sum("count")).first()[0] or 0
    assert counters == alerts
    by_type = sorted(tuple(r) for r in SP.read_alert_counters(spark, sinks).collect())
    assert by_type == sorted(tuple(r) for r in AL.alert_counters(spark.read.parquet(sinks.alerts)).collect())
    published = spark.read.parquet(sinks.alert_messages)
    assert published.columns[:2] == ["key", "value"]
    assert published.count() == published.select("key").distinct().count() == alerts
    prof = SP.read_profiles(spark, sinks)
    assert prof.agg(F.sum("event_count")).first()[0] == n


def test_statistics_freshness_and_reset(spark):
    root = scratch_path(spark, "t-stats")
    sinks = SP.Sinks(f"{root}/tables")
    proc = SP.BatchProcessor(sinks, scorer)
    proc(SP.parsed_flows(to_messages(EV.load_flows(spark, SF_SMALL), WIRE)), 0)
    as_of = F.current_timestamp()
    s1 = SP.refresh_statistics(spark, sinks, as_of).first()
    assert s1.total_predictions == spark.read.parquet(sinks.predictions).count()
    # the snapshot from per-batch deltas equals the document computed over all stored predictions
    proc(SP.parsed_flows(to_messages(EV.load_flows(spark, SF_SMALL), WIRE)).limit(300), 1)
    fresh = SP.refresh_statistics(spark, sinks, as_of, now=0.0 + 10 ** 12).first()
    direct = ST.statistics(spark.read.parquet(sinks.predictions), as_of, 80.0).first()
    for f in ("total_predictions", "total_alerts", "top_attack", "attack_breakdown", "top_ips", "timeline"):
        assert fresh[f] == direct[f], f
    assert fresh.total_predictions == s1.total_predictions + 300
    s1 = fresh
    assert sum(x["count"] for x in s1.attack_breakdown) == s1.total_predictions
    assert s1.top_attack == s1.attack_breakdown[0]["attack_type"]
    # fresh (<= 30 s): the cached row is returned as is
    s2 = SP.refresh_statistics(spark, sinks, as_of).first()
    assert s2.updated_at == s1.updated_at
    SP.reset_tables(spark, sinks)
    assert spark.read.parquet(sinks.predictions).count() == 0
    assert spark.read.parquet(sinks.alerts).count() == 0


def test_dedup_within_watermark(spark):
    root = f"{scratch_path(spark, 't-dedup')}-{uuid.uuid4().hex[:6]}"
    msgs = to_messages(EV.load_flows(spark, SF_SMALL), WIRE)
    msgs.coalesce(1).write.mode("append").parquet(f"{root}/source")
    msgs.coalesce(1).write.mode("append").parquet(f"{root}/source")  # redelivery of every key
    sinks = SP.Sinks(f"{root}/tables")
    stream = SP.file_stream(spark, f"{root}/source", max_files_per_trigger=1)
    flows = SP.parsed_flows(stream, dedup_watermark="24 hours")
    q = SP.start(flows, SP.BatchProcessor(sinks, scorer), f"{root}/checkpoint", available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(sinks.predictions).count() == msgs.count()


def test_malformed_messages_go_to_quarantine(spark):
    root = scratch_path(spark, "t-quarantine")
    sinks = SP.Sinks(f"{root}/tables")
    good = to_messages(EV.load_flows(spark, SF_SMALL), WIRE)
    bad = spark.createDataFrame([("bad-1", "{not json"), ("bad-2", "[1,")], "key string, value string").withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    batch = SP.parsed_flows(good.unionByName(bad))
    SP.BatchProcessor(sinks, scorer)(batch, 0)
    q = spark.read.parquet(sinks.quarantine)
    assert sorted((r.kafka_key, r.corrupt_value) for r in q.collect()) == [("bad-1", "{not json"), ("bad-2", "[1,")]
    assert spark.read.parquet(sinks.predictions).count() == good.count()


def test_messages_without_a_key_are_no_duplicates(spark):
    root = scratch_path(spark, "t-nullkeys")
    msgs = to_messages(EV.load_flows(spark, SF_SMALL), WIRE).limit(20)
    unkeyed = msgs.limit(10).withColumn("key", F.lit(None).cast("string"))
    msgs.unionByName(msgs).unionByName(unkeyed).coalesce(1).write.parquet(f"{root}/source")
    sinks = SP.Sinks(f"{root}/tables")
    flows = SP.parsed_flows(SP.file_stream(spark, f"{root}/source"), dedup_watermark="60 days")
    q = SP.start(flows, SP.BatchProcessor(sinks, scorer), f"{root}/checkpoint", available_now=True)
    q.awaitTermination()
    preds = spark.read.parquet(sinks.predictions)
    assert preds.filter("kafka_key is null").count() == 10
    assert preds.count() == preds.select("kafka_key").distinct().count() + 9


def test_an_empty_rewrite_empties_its_epoch(spark):
    root = scratch_path(spark, "t-empty")
    sinks = SP.Sinks(f"{root}/tables")
    batch = SP.parsed_flows(to_messages(EV.load_flows(spark, SF_SMALL), WIRE))
    SP.BatchProcessor(sinks, scorer)(batch, 0)
    assert spark.read.parquet(sinks.alerts).count() > 0
    SP.BatchProcessor(sinks, scorer, threshold=101.0)(batch, 0)  # the replay raises no alert
    assert spark.read.parquet(sinks.alerts).count() == 0
    assert spark.read.parquet(sinks.alert_messages).count() == 0
    assert spark.read.parquet(sinks.predictions).count() == batch.count()
    SP.BatchProcessor(sinks, scorer)(batch.limit(0), 0)
    assert spark.read.parquet(sinks.predictions).count() == 0


def test_a_new_checkpoint_keeps_the_history(spark):
    root = scratch_path(spark, "t-checkpoints")
    n = write_parts(spark, root, parts=2)
    sinks = SP.Sinks(f"{root}/tables")
    for checkpoint in ("one", "two"):  # the second stream reads everything again
        stream = SP.file_stream(spark, f"{root}/source", max_files_per_trigger=1)
        q = SP.start(SP.parsed_flows(stream), SP.BatchProcessor(sinks, scorer), f"{root}/{checkpoint}", available_now=True)
        q.awaitTermination()
        assert q.exception() is None
    preds = spark.read.parquet(sinks.predictions)
    assert preds.count() == 2 * n
    assert sorted(r.epoch_id for r in preds.select("epoch_id").distinct().collect()) == [0, 1, 2, 3]
    assert SP.progress_frame(spark, sinks).agg(F.sum("input_rows")).first()[0] == 2 * n


def test_topic_reads_are_bounded():
    assert SP.kafka_options("b:9092", "flows", "earliest", 500)["maxOffsetsPerTrigger"] == "500"


def test_plain_folder_is_read_in_bounded_batches_and_deduplicated(spark):
    """Files of a plainly written folder, two a micro-batch at most; a second delivery of
    every message is dropped, none counts as late, whatever the order of the files."""
    root = scratch_path(spark, "t-folder")
    msgs = to_messages(EV.load_flows(spark, SF_SMALL), WIRE)
    for part in msgs.randomSplit([1.0, 1.0, 1.0], seed=3):
        part.coalesce(1).write.mode("append").parquet(f"{root}/source")
    msgs.coalesce(1).write.mode("append").parquet(f"{root}/source")
    sinks = SP.Sinks(f"{root}/tables")
    t = F.unix_seconds("timestamp")
    span = msgs.agg((F.max(t) - F.min(t)).alias("s")).first().s
    flows = SP.parsed_flows(SP.file_stream(spark, f"{root}/source", max_files_per_trigger=2),
                            dedup_watermark=f"{span + 1} seconds")
    q = SP.start(flows, SP.BatchProcessor(sinks, scorer), f"{root}/cp", available_now=True)
    q.awaitTermination()
    assert q.exception() is None
    preds = spark.read.parquet(sinks.predictions)
    assert preds.count() == preds.select("kafka_key").distinct().count() == msgs.count()
    assert preds.select("epoch_id").distinct().count() == 2


def test_statistics_snapshots_are_kept_by_parameters(spark):
    root = scratch_path(spark, "t-stats-params")
    sinks = SP.Sinks(f"{root}/tables")
    SP.BatchProcessor(sinks, scorer)(SP.parsed_flows(to_messages(EV.load_flows(spark, SF_SMALL), WIRE)), 0)
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    ten = SP.refresh_statistics(spark, sinks, as_of, k=10)
    assert len(SP.refresh_statistics(spark, sinks, as_of, k=3).first().top_ips) == 3
    again = SP.refresh_statistics(spark, sinks, as_of, k=10)
    SP.refresh_statistics(spark, sinks, as_of, k=10, now=10.0 ** 12)  # replaces the files, not the callers' rows
    assert len(ten.first().top_ips) == len(again.first().top_ips) == 10


def test_profile_compaction_equals_merge_of_all_deltas(spark):
    root = scratch_path(spark, "t-compact")
    sinks = SP.Sinks(f"{root}/tables")
    proc = SP.BatchProcessor(sinks, scorer)
    msgs = to_messages(EV.load_flows(spark, SF_SMALL), WIRE)
    parts = msgs.randomSplit([1.0, 1.0, 1.0], seed=7)
    for epoch, part in enumerate(parts[:2]):
        proc(SP.parsed_flows(part), epoch)
    SP.compact_profiles(spark, sinks, 1)
    SP.compact_profiles(spark, sinks, 1)  # a retried compaction changes nothing
    proc(SP.parsed_flows(parts[2]), 2)
    got = PR.profiles_for_check(SP.read_profiles(spark, sinks))
    every = PR.profiles_for_check(PR.merge_profiles(spark.read.parquet(sinks.profile_deltas).drop("epoch_id")))
    assert sorted(got.collect()) == sorted(every.collect())
    assert got.agg(F.sum("event_count")).first()[0] == msgs.count()
    SP.compact_profiles(spark, sinks, 2)
    again = PR.profiles_for_check(SP.read_profiles(spark, sinks))
    assert sorted(again.collect()) == sorted(every.collect())
    versions = sorted(r.upto for r in spark.read.parquet(sinks.profile_snapshots).select("upto").distinct().collect())
    assert versions == [1, 2]

"""Structured Streaming job: messages -> parse -> enrich -> classify -> risk ->
raw table, predictions, alerts (+ published payloads), profile deltas.

Exactly-once by construction: every sink is a table partitioned by ``epoch_id``.
A micro-batch takes the epoch after the newest committed one, replaces that folder
whole in every sink (also what an aborted batch left there) and then commits the
epoch in one step (:mod:`flowrisk.streaming.commits`). Readers take committed
epochs only, so none sees half of one. A batch that is replayed after its commit
writes nothing. Streams count their batches on their own; epochs are given in the
order of commits, and a second stream at work at the same time fails at its commit.
Counters and profiles are aggregates over merged deltas, hence exact across replays.
A failed write fails the batch (and the query), so offsets are never committed past lost data.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.operators import alerts as AL
from flowrisk.operators import profiles as PR
from flowrisk.operators import stats as ST
from flowrisk.operators import tables as TB
from flowrisk.operators.enrich import enrich_flows
from flowrisk.operators.messages import parse_messages
from flowrisk.sinks.topic import FileTopic, as_message
from flowrisk.sinks.version_log import VersionLog, delete_folder
from flowrisk.streaming.commits import FANOUT, GRACE_EPOCHS, Commits, Deltas

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Sinks:
    """Table locations under one shared root (the cluster's checkpoint/shared dir)."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw_telemetry"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def alerts(self) -> str:
        return f"{self.root}/alerts"

    @property
    def alert_messages(self) -> str:
        return f"{self.root}/alert_messages"

    @property
    def profile_deltas(self) -> str:
        return f"{self.root}/profile_deltas"

    @property
    def profile_snapshots(self) -> str:
        return f"{self.root}/profile_snapshots"

    @property
    def statistics(self) -> str:
        return f"{self.root}/statistics"

    @property
    def statistics_deltas(self) -> str:
        return f"{self.root}/statistics_deltas"

    @property
    def batch_log(self) -> str:
        return f"{self.root}/batch_metrics"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def commit_log(self) -> str:
        return f"{self.root}/commits"

    @property
    def segments(self) -> str:
        return f"{self.root}/segments"

    def epoch_tables(self) -> list[str]:
        """Tables with one folder an epoch."""
        return [self.raw, self.predictions, self.alerts, self.alert_messages, self.profile_deltas, self.statistics_deltas,
                self.batch_log, self.quarantine]

    def derived(self) -> list[str]:
        """What is made of the epochs."""
        return [self.segments, self.profile_snapshots, self.statistics]


def commits(spark: SparkSession, sinks: Sinks, fanout: int = FANOUT, grace: int = GRACE_EPOCHS) -> Commits:
    """The commit log of the tables, with the segments of their deltas."""
    return Commits(spark, sinks.commit_log, [
        Deltas("profiles", sinks.profile_deltas, f"{sinks.segments}/profiles", PR.merge_profiles),
        Deltas("statistics", sinks.statistics_deltas, f"{sinks.segments}/statistics", ST.merge_deltas),
    ], fanout, grace)


# --------------------------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------------------------


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, starting_offsets: str = "earliest",
                 max_offsets_per_trigger: int = 2_000_000) -> DataFrame:
    """Topic scan (needs the Kafka connector on the classpath); key/value as text.
    A micro-batch takes ``max_offsets_per_trigger`` messages at most, so a long
    backlog is read in bounded batches."""
    raw = spark.readStream.format("kafka").options(**kafka_options(bootstrap, topic, starting_offsets, max_offsets_per_trigger)).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                      F.col("timestamp"))


def kafka_options(bootstrap: str, topic: str, starting_offsets: str, max_offsets_per_trigger: int) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(max_offsets_per_trigger),
        "failOnDataLoss": "false",
    }


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Message files (key, value, timestamp) as a stream — the shape a topic scan yields.
    A micro-batch takes so many files or bytes at most (the file source allows one of the two)."""
    r = spark.readStream.schema(S.MESSAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    elif max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return r.parquet(path)


def parsed_flows(messages: DataFrame, sensor_id: str = S.DEFAULT_SENSOR_ID, as_of: Column | None = None,
                 dedup_watermark: str | None = None) -> DataFrame:
    """Parse + enrich; optionally drop replayed keys within a watermark (off by default).

    Messages without a key are never duplicates of each other and all stay; the
    watermark must cover the time between deliveries of a message."""
    flows = enrich_flows(parse_messages(messages, keep_value=True), sensor_id=sensor_id, as_of=as_of)
    if dedup_watermark:
        timed = flows.withWatermark("kafka_timestamp", dedup_watermark)
        keyed = timed.filter(F.col("kafka_key").isNotNull()).dropDuplicatesWithinWatermark(["kafka_key"])
        flows = keyed.unionByName(timed.filter(F.col("kafka_key").isNull()))
    return flows


# --------------------------------------------------------------------------------------------
# Micro-batch processing
# --------------------------------------------------------------------------------------------


def write_epoch(df: DataFrame, path: str, epoch_id: int, extra_partitions: list[str] | None = None) -> None:
    """Replace the epoch's folder (not only the partitions that ``df`` has rows for)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if extra_partitions:
        w = w.partitionBy(*extra_partitions)
    w.parquet(f"{path}/epoch_id={int(epoch_id)}")


#: What the writes of a micro-batch count as they run: messages read, of these malformed; rows scored,
#: of these at high risk; alert messages sent.
COUNTERS = ("published", "failed", "row_count", "high_risk", "alerts_sent")
#: Stands for the stream's id where a batch is processed outside one.
DIRECT = "direct"


def stream_id(batch: DataFrame) -> str:
    """Id of the streaming query that runs the batch (kept in its checkpoint); ``direct`` outside one."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


class BatchProcessor:
    """``foreachBatch`` body: score once (persisted), write every sink, unpersist."""

    def __init__(self, sinks: Sinks, scorer: Callable[[DataFrame], DataFrame],
                 threshold: float = S.RISK_ALERT_THRESHOLD, ttl_seconds: int = S.ALERT_TTL_SECONDS,
                 clock: Callable[[], Column] | None = None, alert_topic=None,
                 statistics: tuple[int, int] | None = None, fanout: int = FANOUT, grace: int = GRACE_EPOCHS):
        self.sinks = sinks
        self.scorer = scorer
        self.threshold = threshold
        self.ttl_seconds = ttl_seconds
        self.clock = clock or (lambda: F.current_timestamp())
        # where alert payloads are published: a KafkaTopic on a cluster, else a file topic
        self.alert_topic = alert_topic or FileTopic(sinks.alert_messages)
        # (k, hours) of the statistics document that batches keep fresh, if any
        self.statistics = statistics
        self.fanout, self.grace = fanout, grace

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t0 = time.monotonic()
        spark, stream = batch.sparkSession, stream_id(batch)
        log = commits(spark, self.sinks, self.fanout, self.grace)
        # a caller outside a stream may write its newest batch anew
        epoch_id = log.next_epoch(stream, int(batch_id), again=stream == DIRECT)
        if epoch_id is None:
            LOG.info("batch %s of %s is committed already", batch_id, stream)
            return
        source, read = None, None
        if "is_corrupt" in batch.columns:
            source = batch.persist(StorageLevel.MEMORY_AND_DISK)
            kept = [c for c in ("kafka_key", "kafka_timestamp", "corrupt_value") if c in batch.columns]
            read = Observation()
            counted = source.observe(read, F.count(F.lit(1)).alias("published"), F.count_if("is_corrupt").alias("failed"))
            write_epoch(counted.filter(F.col("is_corrupt")).select(*kept), self.sinks.quarantine, epoch_id)
            batch = source.filter(~F.col("is_corrupt")).drop("is_corrupt", "corrupt_value")
        scored = self.scorer(batch).withColumn("created_at", self.clock())
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # the raw table takes no latency: its write scores the batch and counts it
            stored = Observation()
            counted = scored.observe(stored, *ST.batch_counts(self.threshold))
            write_epoch(TB.raw_rows(counted), self.sinks.raw, epoch_id, ["sensor_id"])
            latency_ms = int(round((time.monotonic() - t0) * 1000))
            scored_l = scored.withColumn("prediction_latency_ms", F.lit(latency_ms).cast("int"))
            preds = TB.prediction_docs(scored_l).withColumn("kafka_key", F.col("event.kafka_key"))
            write_epoch(preds, self.sinks.predictions, epoch_id)
            alerts = AL.to_alerts(scored_l, self.threshold, self.ttl_seconds)
            write_epoch(alerts, self.sinks.alerts, epoch_id)
            sent = Observation()
            messages = as_message(AL.alert_payload(alerts), "alert_id", "payload").observe(sent, F.count(F.lit(1)).alias("alerts_sent"))
            self.alert_topic.publish(messages, epoch_id)
            write_epoch(PR.batch_profiles(scored_l), self.sinks.profile_deltas, epoch_id)
            write_epoch(ST.statistics_delta(scored_l, self.threshold), self.sinks.statistics_deltas, epoch_id)
            counters = {"row_count": 0, "high_risk": 0} | stored.get
            counters = {"published": counters["row_count"], "failed": 0} | counters | (read.get if read else {}) | sent.get
            counters = {c: int(counters[c]) for c in COUNTERS} | {"elapsed_ms": int(round((time.monotonic() - t0) * 1000)), "latency_ms": latency_ms}
            one_row = spark.createDataFrame([tuple(counters.values())], ", ".join(f"{c} {'int' if c == 'latency_ms' else 'bigint'}" for c in counters))
            write_epoch(one_row, self.sinks.batch_log, epoch_id)
            log.commit(epoch_id, stream, int(batch_id), **counters)
            LOG.info("epoch %s: %s", epoch_id, counters)
        finally:
            scored.unpersist()
            if source is not None:
                source.unpersist()
        if self.statistics:
            refresh_statistics(spark, self.sinks, F.current_timestamp(), *self.statistics)


def start(stream: DataFrame, processor: BatchProcessor, checkpoint: str, available_now: bool = False,
          trigger_interval: str = "10 seconds"):
    w = stream.writeStream.foreachBatch(processor).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger_interval)
    return w.start()


# --------------------------------------------------------------------------------------------
# Read side
# --------------------------------------------------------------------------------------------


def read_committed(spark: SparkSession, sinks: Sinks, path: str) -> DataFrame:
    """Rows of a table's committed epochs."""
    return commits(spark, sinks).committed(path)


def read_raw(spark: SparkSession, sinks: Sinks) -> DataFrame:
    """Raw table with keyed-upsert semantics: per (sensor_id, event_time), the
    latest epoch, then latest arrival, then largest key wins."""
    raw = commits(spark, sinks).committed(sinks.raw)
    up = TB.keyed_upsert(raw, ["sensor_id", "event_time"], ["epoch_id", "arrival", "kafka_key"])
    return up.drop("epoch_id", "arrival", "kafka_key")


def read_profiles(spark: SparkSession, sinks: Sinks) -> DataFrame:
    """Profiles = the live segments merged (each committed epoch counted once)."""
    return commits(spark, sinks).merged("profiles")


def compact_profiles(spark: SparkSession, sinks: Sinks, upto_epoch: int) -> None:
    """Keep the profiles as they were after ``upto_epoch`` as a snapshot of its own
    (a partition ``upto``; one that is there already stays). Its segments must still be kept."""
    from pyspark.errors import AnalysisException

    try:
        kept = spark.read.parquet(sinks.profile_snapshots).agg(F.max("upto").alias("u")).first()["u"]
    except AnalysisException:
        kept = None
    if kept is not None and upto_epoch <= kept:
        return
    (
        commits(spark, sinks).merged("profiles", int(upto_epoch)).withColumn("upto", F.lit(int(upto_epoch)).cast("bigint"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto")
        .parquet(sinks.profile_snapshots)
    )


def read_alert_counters(spark: SparkSession, sinks: Sinks) -> DataFrame:
    """All-time alert counters per attack type, from the statistics deltas (each
    batch's alerts per type, same threshold as its alerts table), so a read does not
    rescan every alert ever raised."""
    d = commits(spark, sinks).merged("statistics").filter((F.col("gid") == 3) & (F.col("alerts") > 0))
    return d.groupBy("attack_type").agg(F.sum("alerts").cast("bigint").alias("count"))


def refresh_statistics(spark: SparkSession, sinks: Sinks, as_of: Column, k: int = 10, hours: int = 24,
                       max_age_seconds: int = S.STATS_STALE_SECONDS, now: float | None = None) -> DataFrame:
    """Statistics snapshot, recomputed only when older than ``max_age_seconds``.

    A refresh reads the merged statistics deltas (written by each batch, with the
    batch's alert threshold), not the predictions themselves. Documents are kept per
    (k, hours), and their age is that of the write, whatever ``as_of`` is. Each is a
    version of its own: a refresh adds one and then removes those before the last, so a
    reader in between meets a whole one. It is one row (attack types, k addresses, hours)
    and returned detached from the files.
    """
    path = f"{sinks.statistics}/k={int(k)}/hours={int(hours)}"
    wall = now if now is not None else time.time()
    versions = VersionLog(spark, f"{path}/versions")
    number, state = versions.newest()
    if state is None or not 0 <= wall - state["refreshed_at"] <= max_age_seconds:
        folder = f"{path}/document-{uuid.uuid4().hex[:12]}"
        ST.statistics_from_deltas(commits(spark, sinks).merged("statistics"), as_of, k, hours).write.parquet(folder)
        versions.put(number + 1, {"folder": folder, "before": (state or {}).get("folder"), "refreshed_at": time.time()})
        if state and state["before"]:
            delete_folder(spark, state["before"])
        state = {"folder": folder}
    doc = spark.read.parquet(state["folder"])
    return spark.createDataFrame(doc.collect(), doc.schema)


def reset_tables(spark: SparkSession, sinks: Sinks) -> None:
    """Empty every pipeline table (its schema stays) and forget the epochs."""
    from pyspark.errors import AnalysisException

    commits(spark, sinks).clear()
    for path in sinks.derived():
        delete_folder(spark, path)
    for path in sinks.epoch_tables():
        try:
            table = spark.read.parquet(path)
        except AnalysisException:
            continue
        empty = spark.createDataFrame([], table.drop("epoch_id").schema)
        delete_folder(spark, path)
        empty.write.parquet(f"{path}/epoch_id=-1")


def progress_frame(spark: SparkSession, sinks: Sinks) -> DataFrame:
    """Counters of every micro-batch (messages, rows, alerts, time, rate) from the batch log,
    which each batch writes; however many batches a stream has run. The counts are observed
    in the writes themselves, so they cost no job of their own."""
    log = commits(spark, sinks).committed(sinks.batch_log)
    return log.select(
        F.col("epoch_id").cast("bigint").alias("batch_id"),
        "published",
        "failed",
        F.col("row_count").alias("input_rows"),
        "high_risk",
        "alerts_sent",
        F.col("latency_ms").cast("bigint").alias("trigger_ms"),
        "elapsed_ms",
        (F.col("published") * 1000.0 / F.greatest("elapsed_ms", F.lit(1))).alias("processed_rows_per_sec"),
    )

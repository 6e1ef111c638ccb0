"""Aggregates that a stream keeps up to date: profiles on a state store, and a timeline with late rows.

``ProfileStates`` is the sink of an aggregation in update mode. The state store holds one
row per address and attack type; a micro-batch hands on the rows it changed, and the newest
of each key is the profile's part. The state grows with the addresses, not with the rows,
so no watermark bounds it; clusters keep it in RocksDB (``session.CLUSTER_CONF``).

``Timeline`` counts rows by hour as they come. The watermark of an epoch is the newest
time that earlier epochs have seen less the allowed delay; it is a fact of the commit log, so a
replayed batch splits its rows as the first try did. A row whose hour had ended by the
watermark is late: it is written whole to a table of its own and is in no count. Rows
without a time are never late; their hour is null, and the timeline leaves them out.

Both commit their epochs like the other sinks (:mod:`flowrisk.streaming.commits`): a replay
after the commit writes nothing, and their deltas are merged in levels.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions import scalar as X
from flowrisk.operators import profiles as PR
from flowrisk.streaming.commits import FANOUT, GRACE_EPOCHS, Commits, Deltas
from flowrisk.streaming.pipeline import stream_id, write_epoch


def newest_cells(states: DataFrame) -> DataFrame:
    """The newest state of each key: a state holds all that came before it."""
    newest = states.groupBy("source_ip", "attack_type").agg(F.max(F.struct("version", "n", "latest", "peak")).alias("s"))
    return newest.select("source_ip", "attack_type", "s.*")


class ProfileStates:
    """``foreachBatch`` sink of ``profile_cells`` over a stream, in update mode."""

    def __init__(self, root: str, fanout: int = FANOUT, grace: int = GRACE_EPOCHS):
        self.root, self.fanout, self.grace = root, fanout, grace

    def commits(self, spark: SparkSession) -> Commits:
        deltas = Deltas("states", f"{self.root}/states", f"{self.root}/merged", newest_cells)
        return Commits(spark, f"{self.root}/commits", [deltas], self.fanout, self.grace)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        log, stream = self.commits(batch.sparkSession), stream_id(batch)
        epoch = log.next_epoch(stream, int(batch_id))
        if epoch is None:
            return
        write_epoch(batch.withColumn("version", F.lit(epoch).cast("bigint")), f"{self.root}/states", epoch)
        log.commit(epoch, stream, int(batch_id))

    def start(self, scored: DataFrame, checkpoint: str, available_now: bool = False, trigger_interval: str = "10 seconds"):
        """Run the aggregation over a stream of scored flows."""
        w = PR.profile_cells(scored).writeStream.foreachBatch(self).outputMode("update").option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger_interval)).start()

    def read(self, spark: SparkSession) -> DataFrame:
        """Profiles over all committed epochs."""
        return PR.fold_cells(self.commits(spark).merged("states").drop("version"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("timestamp").agg(F.sum("count").cast("bigint").alias("count"))


class Timeline:
    """``foreachBatch`` sink: rows of a stream counted by hour, late ones in a table."""

    def __init__(self, root: str, delay_micros: int, time_col: str = "created_at", fanout: int = FANOUT, grace: int = GRACE_EPOCHS):
        self.root, self.delay, self.time, self.fanout, self.grace = root, int(delay_micros), time_col, fanout, grace

    def commits(self, spark: SparkSession) -> Commits:
        deltas = Deltas("hours", f"{self.root}/hours", f"{self.root}/merged", _summed)
        return Commits(spark, f"{self.root}/commits", [deltas], self.fanout, self.grace)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        log, stream = self.commits(batch.sparkSession), stream_id(batch)
        epoch = log.next_epoch(stream, int(batch_id))
        if epoch is None:
            return
        watermark = (log.log.newest()[1] or {}).get("watermark")
        hour = F.date_trunc("hour", X.col(self.time))
        ended = F.unix_micros(hour + F.make_interval(hours=F.lit(1)))
        late = F.coalesce(ended <= F.lit(watermark).cast("bigint"), F.lit(False))
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted = batch.groupBy(hour.alias("timestamp"), late.alias("late")).agg(
                F.count(F.lit(1)).alias("count"), F.max(F.unix_micros(X.col(self.time))).alias("newest")).persist(StorageLevel.MEMORY_AND_DISK)
            facts = counted.agg(F.max("newest").alias("newest"), F.coalesce(F.sum(F.when(F.col("late"), F.col("count"))), F.lit(0)).alias("late")).first()
            write_epoch(batch.filter(late), f"{self.root}/late", epoch)
            write_epoch(counted.filter(~F.col("late")).select("timestamp", "count"), f"{self.root}/hours", epoch)
            counted.unpersist()
        finally:
            batch.unpersist()
        seen = [watermark] if watermark is not None else []
        seen += [facts["newest"] - self.delay] if facts["newest"] is not None else []
        log.commit(epoch, stream, int(batch_id), watermark=max(seen) if seen else None, late_rows=int(facts["late"]))

    def start(self, rows: DataFrame, checkpoint: str, available_now: bool = False, trigger_interval: str = "10 seconds"):
        w = rows.writeStream.foreachBatch(self).outputMode("append").option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger_interval)).start()

    def read(self, spark: SparkSession, as_of: Column | None = None, hours: int = 24) -> DataFrame:
        """Counts by hour; with ``as_of`` only those of the ``hours`` before it (whole hours from the bound's own)."""
        counts = self.commits(spark).merged("hours").filter(F.col("timestamp").isNotNull())
        if as_of is None:
            return counts
        return counts.filter(F.col("timestamp") >= F.date_trunc("hour", as_of - F.make_interval(hours=F.lit(hours))))

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came late, of committed epochs."""
        return self.commits(spark).committed(f"{self.root}/late").drop("epoch_id")

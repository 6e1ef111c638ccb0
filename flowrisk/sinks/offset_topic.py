"""A topic on shared storage, read by offsets.

Messages of a partition are numbered without gaps in the order of appends, inside one by time
and key. An append range-partitions its messages by partition, time and key, so a busy
partition is spread over many tasks; a row's offset is its place in its task plus the
rows of the partition in earlier tasks and appends. Each file holds one run of offsets of
one partition; an index (a table with a row a file) names it. One state of a version log lists an
append's data and index folders and each partition's end, so an append is seen whole or not at all,
and of two writers at a time one fails.

``read`` takes the files that overlap the wanted offsets from the index and opens no other.

Rows without a key or time come first in their order; equal rows keep any order among each other. A
null partition is refused. Offsets outside a partition are no error: there is nothing to read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.session import checkpoint_root
from flowrisk.sinks.version_log import VersionLog

_DATA = "partition int, offset bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.MESSAGE_SCHEMA.fields)
_INDEX = "partition int, first_offset bigint, last_offset bigint, file string"


class OffsetTopic:
    def __init__(self, spark: SparkSession, path: str, file_rows: int = 1_000_000):
        self.spark, self.path, self.file_rows = spark, path.rstrip("/"), file_rows
        self.log = VersionLog(spark, f"{self.path}/versions")

    def _state(self) -> tuple[int, dict]:
        version, state = self.log.newest()
        return version, state or {"indexes": [], "ends": {}}

    def ends(self) -> dict[int, int]:
        """The offset behind the last message of each partition."""
        return {int(p): n for p, n in self._state()[1]["ends"].items()}

    def append(self, messages: DataFrame, partition: Column) -> None:
        """Add (key, value, timestamp) messages; ``partition`` gives each one's partition."""
        version, state = self._state()
        checkpoint_root(self.spark)
        order = ["partition", "timestamp", "key", "value"]
        dealt = messages.select("key", "value", "timestamp", F.coalesce(partition.cast("int"), F.raise_error("a message has no partition").cast("int")).alias("partition"))
        # kept as they lie, since places in tasks count
        dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
        placed = dealt.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
        # a task holds a run of partitions: rows here are at most the tasks and the partitions together
        runs = placed.groupBy("partition", "task").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("partition").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = self.spark.createDataFrame([(int(p), n) for p, n in state["ends"].items()], "partition int, end bigint")
        shifts = (runs.withColumn("before", before).join(F.broadcast(ends), "partition", "left")
                  .select("partition", "task", (F.coalesce("end", F.lit(0)) + F.col("before") - F.col("start")).alias("shift")))
        numbered = placed.join(F.broadcast(shifts), ["partition", "task"]).select(
            "partition", (F.col("place") + F.col("shift")).cast("bigint").alias("offset"), "key", "value", "timestamp")
        folder = f"{self.path}/append={version + 1}-{uuid.uuid4().hex[:8]}"
        (numbered.withColumn("of", F.col("partition")).sortWithinPartitions("partition", "offset").write.partitionBy("of")
         .option("maxRecordsPerFile", self.file_rows).parquet(f"{folder}/data"))
        # files are named from the topic's folder on, so it may be mounted elsewhere
        name = F.concat(F.lit(f"{folder[len(self.path) + 1:]}/data/of="), F.col("partition").cast("string"), F.lit("/"), F.col("_metadata.file_name"))
        index = (self._data([f"{folder}/data"]).groupBy("partition", name.alias("file"))
                 .agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")))
        index.select("partition", "first_offset", "last_offset", "file").write.parquet(f"{folder}/index")
        found = self.spark.read.schema(_INDEX).parquet(f"{folder}/index").groupBy("partition").agg(F.max("last_offset").alias("last")).collect()
        self.log.put(version + 1, {"indexes": [*state["indexes"], f"{folder}/index"],
                                   "ends": state["ends"] | {str(r["partition"]): r["last"] + 1 for r in found}})

    def _data(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_DATA).parquet(*paths)

    def files(self, start: dict[int, int], end: dict[int, int]) -> list[str]:
        """Files that hold an offset of the ranges."""
        indexes = self._state()[1]["indexes"]
        wanted = [(int(p), int(start.get(p, 0)), int(e)) for p, e in end.items() if start.get(p, 0) < e]
        if not indexes or not wanted:
            return []
        index = self.spark.read.schema(_INDEX).parquet(*indexes)
        ranges = self.spark.createDataFrame(wanted, "partition int, start bigint, end bigint")
        hit = index.join(F.broadcast(ranges), "partition").where("first_offset < end AND last_offset >= start")
        return sorted(f"{self.path}/{r['file']}" for r in hit.select("file").collect())

    def read(self, start: dict[int, int], end: dict[int, int]) -> DataFrame:
        """Messages of offsets ``[start, end)`` of each partition in ``end`` (start 0 if it is not given)."""
        files = self.files(start, end)
        if not files:
            return self.spark.createDataFrame([], _DATA)
        inside = F.lit(False)
        for p, e in sorted(end.items()):
            inside |= (F.col("partition") == p) & (F.col("offset") >= F.lit(int(start.get(p, 0)))) & (F.col("offset") < F.lit(int(e)))
        return self._data(files).filter(inside)

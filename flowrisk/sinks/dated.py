"""Tables in date partitions, sorted by time, with retention and seeks.

A table is a set of folders, one or a few a date, that the newest state of a version log
lists. Every change writes new folders and then puts one state; folders it replaced are
removed ``grace`` changes later, so a reader of an earlier state finds its files meanwhile.

- ``append`` adds rows. With ``keys`` the last write of a key (largest ``order``) wins: the
  touched dates are merged with what they hold, others stay as they are. A key must hold
  the time column, or its rows could lie in several dates.
- ``sweep`` removes expired rows: dates before the edge go as folders, without being
  read; only the edge date is written anew.
- ``recent`` reads newest rows, of one cluster value and behind a cursor if wanted. Counts
  by hour (kept beside the table) tell how far back it must look, so the scan gets the
  folders of those dates and a lower time bound that skips row groups; its cost does not
  depend on how far the cursor has come or how long the table's history is.

Rows are range-partitioned by date, cluster columns and time before they are written, so
a hot sensor or date is spread over tasks, and files hold runs of time.

Rows without a time lie in a part of their own that no sweep removes; ``recent`` does not
read them (they have no place in its order).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowrisk.functions import scalar as X
from flowrisk.operators.tables import keyed_upsert
from flowrisk.sinks.version_log import VersionLog, delete_folder

UNDATED = "undated"
#: Folders of a date before they are merged into one (tables without keys).
FOLDERS = 8


class DatedTable:
    def __init__(self, spark: SparkSession, path: str, time_col: str, cluster: tuple[str, ...] = (), keys: tuple[str, ...] = (),
                 order: tuple[str, ...] = (), grace: int = 2):
        if keys and time_col not in keys:
            raise ValueError("the keys must hold the time column")
        self.spark, self.path, self.time, self.cluster, self.keys, self.order, self.grace = spark, path, time_col, list(cluster), list(keys), list(order), grace
        self.log = VersionLog(spark, f"{path}/versions")

    # --- state ---------------------------------------------------------------------------

    def state(self) -> tuple[int, dict]:
        version, state = self.log.newest()
        return version, state or {"parts": {}, "counts": None, "retired": [], "schema": None}

    def parts(self) -> dict[str, list[str]]:
        """Live folders by date."""
        return self.state()[1]["parts"]

    def _put(self, version: int, state: dict, parts: dict[str, list[str]], counts: str | None, schema: str | None) -> None:
        live = {f for folders in parts.values() for f in folders} | {counts}
        gone = [f for folders in state["parts"].values() for f in folders if f not in live] + ([state["counts"]] if state["counts"] not in live else [])
        retired = [*state["retired"], *([version, f] for f in gone if f)]
        for at, folder in retired:
            if at <= version - self.grace:
                delete_folder(self.spark, folder)
        self.log.put(version, {"parts": parts, "counts": counts, "schema": schema, "retired": [r for r in retired if r[0] > version - self.grace]})

    # --- writing -------------------------------------------------------------------------

    def _date(self) -> Column:
        return F.coalesce(F.to_date(X.col(self.time)).cast("string"), F.lit(UNDATED))

    def _write(self, df: DataFrame, version: int) -> str:
        """Rows of some dates into a folder a date."""
        folder = f"{self.path}/v={version}-{uuid.uuid4().hex[:8]}"
        by = ["event_date", *self.cluster, self.time]
        dealt = df.withColumn("event_date", self._date()).repartitionByRange(*[X.col(c) for c in by]).sortWithinPartitions(*[X.col(c) for c in by])
        dealt.write.partitionBy("event_date").parquet(folder)
        return folder

    def _count(self, paths: list[str], version: int, before: str | None, dates: list[str]) -> str:
        """Rows by date, cluster columns and hour: those of ``dates`` from ``paths``, others as before."""
        to = f"{self.path}/counts={version}-{uuid.uuid4().hex[:8]}"
        keys = [self._date().alias("event_date"), *[X.col(c) for c in self.cluster], F.date_trunc("hour", X.col(self.time)).alias("hour")]
        new = None
        if paths:
            new = self.spark.read.parquet(*paths).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        if before:
            old = self.spark.read.parquet(before).filter(~F.col("event_date").isin(dates))
            new = old if new is None else old.unionByName(new)
        new.coalesce(1).write.parquet(to)
        return to

    def append(self, df: DataFrame) -> None:
        version, state = self.state()
        version += 1
        dates = sorted(r["d"] for r in df.select(self._date().alias("d")).distinct().collect())
        if not dates:
            if not state["schema"]:
                self._put(version, state, {}, None, df.schema.json())
            return
        parts = dict(state["parts"])
        merged = [d for d in dates if self.keys or len(parts.get(d, [])) + 1 >= FOLDERS]
        held = [f for d in merged for f in parts.get(d, [])]
        if held:
            df = df.unionByName(self.spark.read.parquet(*held))
        if self.keys:
            df = keyed_upsert(df, self.keys, self.order).select(*[X.col(c) for c in df.columns])
        folder = self._write(df, version)
        for d in dates:
            parts[d] = [f"{folder}/event_date={d}"] if d in merged else [*parts.get(d, []), f"{folder}/event_date={d}"]
        counts = self._count([f for d in dates for f in parts[d]], version, state["counts"], dates)
        self._put(version, state, parts, counts, df.schema.json())

    def sweep(self, as_of: Column, seconds: int) -> dict[str, list[str]]:
        """Remove rows older than ``seconds`` before ``as_of``. Returns the dates that were
        dropped, and the one that was written anew."""
        version, state = self.state()
        edge = self.spark.range(1).select((as_of - F.make_interval(secs=F.lit(seconds))).alias("t")).select(
            F.unix_micros("t").alias("micros"), F.to_date("t").cast("string").alias("date")).first()
        keep = X.col(self.time) >= F.timestamp_micros(F.lit(edge["micros"]))
        dropped = sorted(d for d in state["parts"] if d != UNDATED and d < edge["date"])
        parts = {d: f for d, f in state["parts"].items() if d not in dropped}
        anew: list[str] = []
        if edge["date"] in parts:
            at_edge = self.spark.read.parquet(*parts[edge["date"]])
            if not at_edge.filter(~keep).isEmpty():
                anew = [edge["date"]]
        if not dropped and not anew:
            return {"dropped": [], "rewritten": []}
        version += 1
        for d in anew:
            left = at_edge.filter(keep)
            if left.isEmpty():
                del parts[d]
            else:
                parts[d] = [f"{self._write(left, version)}/event_date={d}"]
        counts = self._count([f for d in anew for f in parts.get(d, [])], version, state["counts"], [*dropped, *anew])
        self._put(version, state, parts, counts, state["schema"])
        return {"dropped": dropped, "rewritten": anew}

    # --- reading -------------------------------------------------------------------------

    def _frame(self, folders: list[str]) -> DataFrame:
        schema = self.state()[1]["schema"]
        if schema is None:
            raise ValueError(f"{self.path}: no rows were ever appended")
        schema = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._frame([f for folders in self.parts().values() for f in folders])

    def recent(self, limit: int, key_col: str | None = None, cluster_value: str | None = None, before: tuple | None = None) -> DataFrame:
        """The newest ``limit`` rows, newest first (ties by ``key_col``, largest first): those of one
        value of the first cluster column, and behind the cursor ``before`` = (time, key), if given.
        ``limit`` rows of the first hours that hold as many, so older files are not opened."""
        version, state = self.state()
        time = X.col(self.time)
        order = [F.desc(self.time), *([F.desc(key_col)] if key_col else [])]
        cursor = None
        if before:
            at = F.lit(before[0]).cast("timestamp")
            cursor = (time < at) | ((time == at) & (X.col(key_col) < F.lit(before[1]))) if key_col else time < at
        if not state["counts"]:
            return self._frame([]).limit(limit)
        counts = self.spark.read.parquet(state["counts"]).filter(F.col("hour").isNotNull())
        if cluster_value is not None:
            counts = counts.filter(X.col(self.cluster[0]) == cluster_value)
        # the cursor's own hour is read, but may have no row left
        sure = F.col("rows")
        if before:
            counts = counts.filter(F.col("hour") <= at)
            sure = F.when(F.col("hour") < F.date_trunc("hour", at), F.col("rows")).otherwise(0)
        hours = counts.groupBy("hour").agg(F.sum(sure).alias("rows"), F.max("event_date").alias("event_date"))
        far = hours.withColumn("so_far", F.sum("rows").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, 0)))
        bounds = far.agg(
            F.max(F.when(F.col("so_far") >= limit, F.struct(F.unix_micros("hour").alias("m"), "event_date"))).alias("enough"),
            F.min(F.struct(F.unix_micros("hour").alias("m"), "event_date")).alias("all"), F.max("event_date").alias("newest")).first()
        low = bounds["enough"] or bounds["all"]
        if low is None:
            return self._frame([]).limit(limit)
        folders = [f for d, fs in state["parts"].items() if low["event_date"] <= d <= bounds["newest"] and d != UNDATED for f in fs]
        rows = self._frame(folders).filter(time >= F.timestamp_micros(F.lit(low["m"])))
        if cluster_value is not None:
            rows = rows.filter(X.col(self.cluster[0]) == cluster_value)
        if before:
            rows = rows.filter((time <= at) & cursor)
        return rows.orderBy(*order).limit(limit)

"""Dashboard statistics over stored predictions.

Each aggregate does map-side partial aggregation, so a hot attack type or source
address never lands in one task as raw rows; everything packed into arrays has
been reduced first to a bounded size (attack types, top-K, hour buckets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def attack_breakdown(preds: DataFrame) -> DataFrame:
    """Count per predicted attack, largest first, ties by name."""
    return (
        preds.groupBy(F.col("predicted_attack").alias("attack_type"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("attack_type"))
    )


def stats_summary(preds: DataFrame) -> DataFrame:
    """Grand total and the most frequent attack (ties by name), from the breakdown."""
    b = preds.groupBy(F.col("predicted_attack").alias("attack_type")).agg(F.count(F.lit(1)).alias("count"))
    return b.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_predictions"),
        F.min_by("attack_type", F.struct(F.lit(0) - F.col("count"), F.col("attack_type"))).alias("top_attack"),
    )


def top_ips(preds: DataFrame, k: int = 10) -> DataFrame:
    """Top-K source addresses by prediction count, ties by address."""
    return (
        preds.groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("source_ip"))
        .limit(k)
    )


def timeline(preds: DataFrame, as_of: Column, hours: int = 24, time_col: str = "created_at") -> DataFrame:
    """Predictions per hour over the last ``hours`` hours; empty hours are absent."""
    ts = F.col(time_col)
    return (
        preds.filter(ts >= as_of - F.make_interval(hours=F.lit(hours)))
        .groupBy(F.date_trunc("hour", ts).alias("timestamp"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("timestamp")
    )


def attack_share(preds: DataFrame) -> DataFrame:
    """Percent of all predictions per attack type.

    The window has no partition key, but runs over the already-reduced
    breakdown (one row per attack type), never over raw rows.
    """
    b = preds.groupBy(F.col("predicted_attack").alias("attack_type")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return b.select("attack_type", "count", F.round(F.col("count") * 100.0 / total, 2).alias("percent"))


def top_ip_bars(preds: DataFrame, k: int = 8) -> DataFrame:
    """Rank and bar width (percent of the largest count) for the top-K addresses."""
    top = top_ips(preds, k)
    w = Window.orderBy(F.desc("count"), F.asc("source_ip"))
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"),
        "source_ip",
        "count",
        F.round(F.col("count") * 100.0 / F.max("count").over(Window.partitionBy()), 0).cast("int").alias("bar_percent"),
    )


def batch_counts(threshold: float) -> list[Column]:
    """Row count and high-risk count, to be aggregated or observed."""
    return [F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("risk_score") >= F.lit(float(threshold))).alias("high_risk")]


def batch_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """Row count, emptiness and high-risk count in one pass."""
    rows, high = batch_counts(threshold)
    return scored.agg(rows, (F.count(F.lit(1)) == 0).alias("is_empty"), high)


def statistics(preds: DataFrame, as_of: Column, threshold: float, k: int = 10, hours: int = 24) -> DataFrame:
    """The statistics document as one row, from one scan.

    One ``GROUPING SETS`` aggregate (attack type / source address / hour in the
    window) with partial aggregation before its single shuffle gives the
    breakdown, the alert counters (a filtered count per type), the timeline
    and the per-address counts. Only bounded pieces are packed: attack types,
    hour buckets, and the top-K addresses.

    The aggregate has one consumer, so the input is scanned once. The top-K
    is a ``row_number`` window partitioned by the grouping columns: every type
    and hour row is alone in its partition (rank 1), the address rows share
    one, and ``rank <= k`` lets Spark keep only the best ``k`` per task before
    that partition's shuffle (a window group limit). No joins.
    """
    ts = F.col("created_at")
    base = preds.select(
        F.col("predicted_attack").alias("attack_type"),
        F.col("source_ip"),
        F.when(ts >= as_of - F.make_interval(hours=F.lit(hours)), F.date_trunc("hour", ts)).alias("hour"),
        (F.col("risk_score") >= F.lit(float(threshold))).alias("is_alert"),
    )
    # grouping_id bits (attack_type, source_ip, hour): 3 = by type, 5 = by address, 6 = by hour
    sets = base.groupingSets([["attack_type"], ["source_ip"], ["hour"]], "attack_type", "source_ip", "hour").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("is_alert").alias("alerts"),
        F.grouping_id().alias("gid"),
    )
    return _pack(sets, as_of, k)


def statistics_delta(preds: DataFrame, threshold: float) -> DataFrame:
    """What one micro-batch adds to the statistics: counts (and alerts) per
    attack type, per source address and per exact ``created_at``.

    In the stream every row of a batch carries the batch's processing time, so
    the time rows are few; keeping exact times keeps the window test exact.
    Rows: ``gid`` (3 type, 5 address, 6 time), the key columns, ``count``, ``alerts``.
    """
    base = preds.select(
        F.col("predicted_attack").alias("attack_type"),
        F.col("source_ip"),
        F.col("created_at"),
        (F.col("risk_score") >= F.lit(float(threshold))).alias("is_alert"),
    )
    return base.groupingSets([["attack_type"], ["source_ip"], ["created_at"]], "attack_type", "source_ip",
                             "created_at").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("is_alert").alias("alerts"),
        F.grouping_id().alias("gid"),
    )


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas of several batches as one of the same shape (associative)."""
    return deltas.groupBy("attack_type", "source_ip", "created_at", "gid").agg(
        F.sum("count").alias("count"), F.sum("alerts").alias("alerts")).select(
        "attack_type", "source_ip", "created_at", "count", "alerts", "gid")


def statistics_from_deltas(deltas: DataFrame, as_of: Column, k: int = 10, hours: int = 24) -> DataFrame:
    """The statistics document from stored per-batch deltas: the deltas are
    re-aggregated by key (times folded into in-window hours), then packed as
    in :func:`statistics`. The work grows with the number of batches and
    distinct keys, not with the rows ever scored."""
    ts = F.col("created_at")
    in_window = F.when(ts >= as_of - F.make_interval(hours=F.lit(hours)), F.date_trunc("hour", ts))
    sets = deltas.select(
        "gid", "attack_type", "source_ip",
        F.when(F.col("gid") == 6, in_window).alias("hour"),
        "count", "alerts",
    ).groupBy("gid", "attack_type", "source_ip", "hour").agg(
        F.sum("count").alias("count"), F.sum("alerts").alias("alerts"))
    return _pack(sets, as_of, k)


def _pack(sets: DataFrame, as_of: Column, k: int) -> DataFrame:
    """(gid, attack_type, source_ip, hour, count, alerts) -> the one-row document."""
    rank = F.row_number().over(
        Window.partitionBy("gid", "attack_type", "hour").orderBy(F.desc("count"), F.asc("source_ip")))
    parts = (
        sets.filter((F.col("gid") != 6) | F.col("hour").isNotNull())
        .withColumn("rank", rank)
        .filter(F.col("rank") <= F.lit(k))
    )
    return parts.agg(
        F.expr("coalesce(sum(count) FILTER (WHERE gid = 3), 0)").cast("bigint").alias("total_predictions"),
        F.expr("coalesce(sum(alerts) FILTER (WHERE gid = 3), 0)").cast("bigint").alias("total_alerts"),
        F.expr("min_by(attack_type, struct(-count, attack_type)) FILTER (WHERE gid = 3)").alias("top_attack"),
        F.expr(
            "transform(array_sort(collect_list(struct(-count AS n, attack_type, count)) FILTER (WHERE gid = 3)),"
            " s -> struct(s.attack_type AS attack_type, s.count AS count))"
        ).alias("attack_breakdown"),
        F.expr(
            "transform(array_sort(collect_list(struct(-count AS n, source_ip, count)) FILTER (WHERE gid = 5)),"
            " s -> struct(s.source_ip AS source_ip, s.count AS count))"
        ).alias("top_ips"),
        F.expr("array_sort(collect_list(struct(hour AS timestamp, count)) FILTER (WHERE gid = 6))").alias("timeline"),
    ).withColumn("updated_at", as_of)


def statistics_rows(doc: DataFrame) -> DataFrame:
    """The statistics document as flat ``(part, position, name, value)`` rows:
    the three summary fields, then every list entry with its 1-based position.
    One ``inline`` over the one-row document (the document is computed once)."""

    def entry(part: str, position: Column, name: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), position.cast("bigint").alias("position"),
                        name.cast("string").alias("name"), value.cast("bigint").alias("value"))

    def listed(col: str, key) -> Column:
        return F.transform(col, lambda x, i: entry(col, i + 1, key(x), x["count"]))

    summary = F.array(
        entry("summary", F.lit(1), F.lit("total_predictions"), F.col("total_predictions")),
        entry("summary", F.lit(2), F.lit("total_alerts"), F.col("total_alerts")),
        entry("summary", F.lit(3), F.col("top_attack"), F.lit(None)),
    )
    return doc.select(F.inline(F.concat(
        summary,
        listed("attack_breakdown", lambda x: x["attack_type"]),
        listed("top_ips", lambda x: x["source_ip"]),
        listed("timeline", lambda x: F.date_format(x["timestamp"], "yyyy-MM-dd HH:mm:ss")),
    )))

"""Per-source attacker profiles, kept up to date across batches.

A profile is an aggregate that merges associatively, so profiles of two batches
combine into the profile of their union: counts add, the latest fields come
from the row with the largest ``(last_seen, event_time, key)``, peaks take max.

Skew: one address may carry a third of all rows. Every step aggregates with
a map-side partial aggregation (sort aggregates, as the newest row is a struct), so the hot address is reduced
inside each task before anything is shuffled; the per-type counter map is
built only after the rows are reduced to one per (address, type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions import scalar as X

_LATEST = ["last_seen", "latest_attack", "risk_score", "sensor_id"]


def profile_cells(preds: DataFrame, time_col: str = "created_at") -> DataFrame:
    """What a profile is folded from: per address and attack type the count, newest row and peak."""
    order = F.struct(F.col(time_col), F.col("event_time"), F.col("kafka_key"))
    latest = F.struct(
        order.alias("order"),
        F.col(time_col).alias("last_seen"),
        F.col("predicted_attack").alias("latest_attack"),
        F.col("risk_score"),
        F.col("sensor_id"),
    )
    per_type = preds.groupBy("source_ip", "predicted_attack").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(latest).alias("latest"),
        F.max("risk_score").alias("peak"),
    )
    return per_type.select("source_ip", F.col("predicted_attack").alias("attack_type"), "n", "latest", "peak")


def batch_profiles(preds: DataFrame, time_col: str = "created_at") -> DataFrame:
    """Profiles of one set of predictions (the per-batch delta)."""
    return fold_cells(profile_cells(preds, time_col))


def fold_cells(per_type: DataFrame) -> DataFrame:
    """(source_ip, attack_type, n, latest, peak) rows -> one profile per address."""
    agg = per_type.groupBy("source_ip").agg(
        F.sum("n").cast("bigint").alias("event_count"),
        F.map_from_entries(F.collect_list(F.struct(F.col("attack_type"), F.col("n").cast("bigint")))).alias("attack_counts"),
        F.max("latest").alias("latest"),
        F.max("peak").alias("peak_risk_score"),
    )
    return agg.select(
        "source_ip",
        "event_count",
        "attack_counts",
        *[F.col(f"latest.{c}").alias(c) for c in _LATEST],
        "peak_risk_score",
        F.col("latest.order").alias("latest_order"),
    )


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Merge profile tables (stored profiles and new deltas) into one.

    Union, then one re-aggregation per (address, type) and per address; no join,
    so neither side needs to fit anywhere and repeated addresses cannot skew.
    """
    u = profiles[0]
    for p in profiles[1:]:
        u = u.unionByName(p)
    latest = F.struct(
        F.col("latest_order").alias("order"),
        *[F.col(c) for c in _LATEST],
    )
    rows = u.select("source_ip", F.explode("attack_counts").alias("attack_type", "n"), latest.alias("latest"), "peak_risk_score")
    per_type = rows.groupBy("source_ip", "attack_type").agg(
        F.sum("n").alias("n"), F.max("latest").alias("latest"), F.max("peak_risk_score").alias("peak")
    )
    return fold_cells(per_type)


def public_profiles(profiles: DataFrame) -> DataFrame:
    """Stored shape: drop the internal ordering column."""
    return profiles.drop("latest_order")


def profiles_for_check(profiles: DataFrame) -> DataFrame:
    """Profiles with the counter map as canonical text (for engine-neutral comparison)."""
    return public_profiles(profiles).withColumn("attack_counts", X.sorted_counts_text("attack_counts"))


def latest_prediction(preds: DataFrame, time_col: str = "created_at") -> DataFrame:
    """Newest prediction per source address (``max_by`` with partial aggregation)."""
    order = F.struct(F.col(time_col), F.col("event_time"), F.col("kafka_key"))
    body = F.struct(
        F.col("kafka_key"),
        F.col("predicted_attack"),
        F.col("confidence"),
        F.col("risk_score"),
        F.col(time_col).alias("created_at"),
    )
    return preds.groupBy("source_ip").agg(F.max_by(body, order).alias("p")).select("source_ip", "p.*")

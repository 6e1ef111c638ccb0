"""Enrichment and scoring: envelope columns, source address, label decode,
confidence, severity and risk. All are narrow projections (no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.functions import scalar as X


def enrich_columns(
    sensor_id: str | Column = S.DEFAULT_SENSOR_ID,
    event_time: Column | None = None,
    as_of: Column | None = None,
    positive_mod: bool = False,
    port: str | Column = "Destination Port",
) -> dict[str, Column]:
    """The envelope columns as expressions (for callers building one projection)."""
    sensor = F.lit(sensor_id) if isinstance(sensor_id, str) else sensor_id
    fallback = as_of if as_of is not None else F.current_timestamp()
    et = event_time if event_time is not None else F.coalesce(F.col("kafka_timestamp"), fallback)
    return {"sensor_id": sensor, "event_time": et, "source_ip": X.source_ip_from_port(port, positive_mod)}


def enrich_flows(
    df: DataFrame,
    sensor_id: str | Column = S.DEFAULT_SENSOR_ID,
    event_time: Column | None = None,
    as_of: Column | None = None,
    positive_mod: bool = False,
) -> DataFrame:
    """Add ``sensor_id``, ``event_time`` and ``source_ip`` to parsed flows.

    ``event_time`` defaults to the message timestamp, falling back to ``as_of``
    (or the query's current time) when the message has none.
    """
    return df.withColumns(enrich_columns(sensor_id, event_time, as_of, positive_mod))


def decode_labels(df: DataFrame, labels: Sequence[str], index_col: str = "prediction", out: str = "predicted_attack") -> DataFrame:
    return df.withColumn(out, X.decode_label(index_col, labels))


def score_predictions(
    df: DataFrame,
    labels: Sequence[str] | None,
    model_name: str,
    *,
    index_col: str = "prediction",
    probability_col: str | None = "probability",
    confidence_col: str | Column | None = None,
    drop_internals: bool = True,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Classifier output -> ``predicted_attack``, ``confidence``, ``model_name``, ``risk_score``.

    ``labels`` decodes the class index; with ``labels=None`` an existing
    ``predicted_attack`` column is kept. Confidence comes from the probability
    vector (the margins of a one-vs-rest model, which has none), or from ``confidence_col`` (a column or expression) when the
    classifier already gives one. Two projections in all.
    """
    new: dict[str, Column] = {}
    if labels is not None:
        new["predicted_attack"] = X.decode_label(index_col, labels)
    if confidence_col is not None:
        c = confidence_col if isinstance(confidence_col, Column) else F.col(confidence_col)
        new["confidence"] = c.cast("double")
    elif probability_col is not None and probability_col in df.columns:
        new["confidence"] = X.max_probability(probability_col)
    elif probability_col is not None and "rawPrediction" in df.columns:
        new["confidence"] = X.max_margin_probability("rawPrediction")
    new["model_name"] = F.lit(model_name)
    new.update(extra or {})
    out = df.withColumns(new)
    dropped = set(S.ML_INTERNAL_COLUMNS) if drop_internals else set()
    keep = [X.col(c) for c in out.columns if c not in dropped and c != "risk_score"]
    return out.select(*keep, X.risk_score("confidence", "predicted_attack").alias("risk_score"))


def with_severity(df: DataFrame, attack_col: str = "predicted_attack", out: str = "severity") -> DataFrame:
    return df.withColumn(out, X.severity(attack_col))

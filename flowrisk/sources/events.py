"""Adapter: the driver's ``events`` table as a stream of scored network flows.

The analysed pipeline's own flow data set is not available, so flows are
derived from ``events`` with fixed formulas (the same formulas appear in every
oracle query). Every row of ``events`` becomes one flow; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.functions import scalar as X
from flowrisk.operators.enrich import enrich_columns, score_predictions
from flowrisk.sources.tables import read_table

# Event type -> label index; index -> label name.
EVENT_TYPE_INDEX: dict[str, int] = {"signup": 0, "click": 1, "view": 2, "purchase": 3, "error": 4}
ADAPTER_LABELS: list[str] = ["Normal", "Recon", "WebAttack", "Botnet", "DoS/DDoS"]
ADAPTER_MODEL_NAME = "events_adapter"
UNKNOWN_INDEX = 99
#: Flow columns with a formula of their own; the others follow :func:`derived_column`.
OWN_FORMULA = ("Destination Port", "Flow Duration", "Label")
#: The one derived column with nulls (no model feature, so training keeps every row).
NULLABLE = "Idle Std"
DERIVED: list[tuple[int, str, str]] = [(i, n, t) for i, (n, t) in enumerate(S.FLOW_COLUMNS) if n not in OWN_FORMULA]


def _type_index(col_name: str):
    return F.expr(f"try_element_at({X.map_sql(EVENT_TYPE_INDEX)}, {X.sql_name(col_name)})")


def _type_label(col_name: str):
    labels = {name: ADAPTER_LABELS[i] for name, i in EVENT_TYPE_INDEX.items()}
    return F.expr(f"try_element_at({X.map_sql(labels)}, {X.sql_name(col_name)})")


def derived_column(i: int, name: str, kind: str):
    """Flow column ``i`` of the record from the event's ids: a remainder of its own
    modulus; eighths for doubles, so their text is exact."""
    n = (F.col("event_id") * (2 * i + 3) + F.col("user_id") * (i + 1)) % (1000 + 7 * i)
    v = n.cast("double") / 8 if kind == "double" else n.cast(kind)
    return F.when(F.col("event_id") % 97 != 0, v) if name == NULLABLE else v


#: Rows that a task is worth, and those that a task of a spread table has at most.
TASK_ROWS, MOST_ROWS = 12_500, 500_000


def tasks_for(rows: int, wide: int) -> int:
    """Tasks for the work on so many rows: about ``TASK_ROWS`` each on up to ``wide`` tasks,
    and more tasks again rather than above ``MOST_ROWS`` in one."""
    return max(1, min(-(-rows // TASK_ROWS), wide), -(-rows // MOST_ROWS))


def flows_from_events(events: DataFrame, extra: list | None = None, tasks: int = 1) -> DataFrame:
    """Envelope + the whole flow record for each event (two projections; unused columns are
    pruned). No shuffle with ``tasks`` = 1: how a scan is split is left to
    ``spark.sql.files.maxPartitionBytes``. A scan can't split a row group, though, so a table of
    few large ones is one of few tasks; costly work on its rows asks for ``tasks``, to which
    the events (not the wide flows) are dealt, in the same order each time.

    ``events`` must be the Parquet scan itself (the key uses ``_metadata.file_name``);
    ``extra`` columns of the scan are carried along.
    """
    scan = events.select(
        F.col("_metadata.file_name").alias("_file_name"), "event_id", "ts", "user_id", "event_type", "value", "props",
        *(extra or []),
    )
    if tasks > 1:
        scan = scan.repartition(tasks, "event_id", "ts").sortWithinPartitions("event_id", "ts", "_file_name")
    idx = _type_index("event_type")
    port = (F.col("user_id") * 37 % 65536).cast("int")
    kafka_ts = F.col("ts").cast("timestamp")
    env = enrich_columns(
        sensor_id=F.concat(F.lit("sensor-0"), (F.col("user_id") % 3 + 1).cast("string")),
        event_time=F.date_trunc("minute", kafka_ts),
        port=port,
    )
    return scan.select(
        F.concat(F.col("_file_name"), F.lit("-"), F.col("event_id").cast("string")).alias("kafka_key"),
        kafka_ts.alias("kafka_timestamp"),
        port.alias("Destination Port"),
        F.round(F.col("value") * 100, 0).cast("bigint").alias("Flow Duration"),
        _type_label("event_type").alias("Label"),
        idx.alias("label_index"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        *[e.alias(n) for n, e in env.items()],
        *[derived_column(i, n, t).alias(n) for i, n, t in DERIVED],
        *[F.col(c) for c in scan.columns[7:]],
    )


def score_flows_from_events(flows: DataFrame) -> DataFrame:
    """Stand-in classifier: deterministic class index and confidence from ``k``,
    then the real scoring operator (label decode, risk, model name)."""
    k = F.col("k")
    pred = (
        F.when(k % 17 == 0, F.lit(UNKNOWN_INDEX))
        .when(k % 10 == 0, (F.col("label_index") + 1) % 5)
        .otherwise(F.col("label_index"))
    )
    conf = ((F.lit(500) + k * 37 % 501) / F.lit(1000)).cast("double")
    return score_predictions(
        flows.withColumn("prediction", pred.cast("double")), ADAPTER_LABELS, ADAPTER_MODEL_NAME,
        confidence_col=conf, probability_col=None, extra={"created_at": F.col("kafka_timestamp")},
    )


def score_wire_flows(flows: DataFrame) -> DataFrame:
    """Stand-in classifier of the stream: class index and confidence from two wire
    fields (one index in six is unknown), then the real scoring operator."""
    return score_predictions(
        flows.withColumn("prediction", (F.col("`Destination Port`") % 6).cast("double")), ADAPTER_LABELS, ADAPTER_MODEL_NAME,
        confidence_col=((F.col("`Flow Duration`") % 500 + 500) / F.lit(1000)).cast("double"), probability_col=None,
    )


def load_flows(spark: SparkSession, sf_dir: str, tasks: int = 1) -> DataFrame:
    return flows_from_events(read_table(spark, sf_dir, "events"), tasks=tasks)


def load_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_flows_from_events(load_flows(spark, sf_dir))

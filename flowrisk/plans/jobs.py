"""Registered queries that train models or run the streaming job (rows-only checks).

They read the driver's tables, write intermediate tables under the session's
shared checkpoint folder, and return a DataFrame over what they produced.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk import schema as S
from flowrisk.functions import scalar as X
from flowrisk.operators import alerts as AL
from flowrisk.operators import ml as ML
from flowrisk.operators import tables as TB
from flowrisk.operators import variants as VR
from flowrisk.operators.messages import to_messages
from flowrisk.plans.queries import WIRE_FIELDS, as_of_col, register
from flowrisk.session import scratch_path, settings
from flowrisk.sinks.dated import DatedTable
from flowrisk.sinks.offset_topic import OffsetTopic
from flowrisk.sinks.topic import FileTopic
from flowrisk.sinks.version_log import folder_bytes
from flowrisk.sources import events as EV
from flowrisk.sources import footers as FT
from flowrisk.sources.tables import read_table
from flowrisk.streaming import live as SL
from flowrisk.streaming import pipeline as SP

# Reference best point of the forest search (trees x depth).
BEST_RF_TREES = 100
BEST_RF_DEPTH = 10
# Rows of a message file at most; files and micro-batches that the messages make at least, whatever their number.
FILE_ROWS = 500_000
FILES, EPOCHS = 8, 4
#: Tasks (and files) that messages are written by, unless they have above ``EV.MOST_ROWS`` each.
MESSAGE_TASKS = 240


def training_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for training on so many rows: two a core, as each task of a forest's pass makes statistics of all its nodes."""
    return EV.tasks_for(rows, 2 * spark.sparkContext.defaultParallelism)


def flow_features(df: DataFrame) -> list[str]:
    """The model's features; a frame that lacks one breaks the contract and is refused."""
    missing = [f for f in S.MODEL_FEATURES if f not in df.columns]
    if missing:
        raise ValueError(f"model features missing from the flows: {missing}")
    return list(S.MODEL_FEATURES)


def train_flow_model(spark: SparkSession, sf_dir: str, root: str) -> ML.ModelBundle:
    """Fit feature pipeline + forest on the flows, save both, load them back
    through the fallback loader (exercises the saved-model path)."""
    from pyspark.ml.classification import RandomForestClassifier

    tasks = training_tasks(spark, read_table(spark, sf_dir, "events").count())
    flows = EV.load_flows(spark, sf_dir, tasks).drop("label_index")
    feats = flow_features(flows)
    flows = flows.select("Label", *[X.col(f) for f in feats]).persist(StorageLevel.MEMORY_AND_DISK)  # fitting reads it six times
    try:
        pipe = ML.feature_pipeline(feats, "Label").fit(flows)
        rf = RandomForestClassifier(featuresCol=ML.FEATURES, labelCol=ML.LABEL_INDEX, numTrees=BEST_RF_TREES,
                                    maxDepth=BEST_RF_DEPTH, seed=ML.CV_SEED)
        model = rf.fit(pipe.transform(flows))
    finally:
        flows.unpersist()
    pipe.write().overwrite().save(f"{root}/feature_pipeline")
    model.write().overwrite().save(f"{root}/random_forest/bestModel")
    return ML.load_models(f"{root}/feature_pipeline", f"{root}/gbt_missing", f"{root}/random_forest")


@register("feature_vectors")
def q_feature_vectors(spark, sf_dir):
    flows = EV.load_flows(spark, sf_dir).drop("label_index")
    model = ML.feature_pipeline(flow_features(flows), "Label").fit(flows)
    out = model.transform(flows)
    return out.select("kafka_key", ML.LABEL_INDEX, vector_to_array(ML.FEATURES).alias("features"))


@register("feature_values")
def q_feature_values(spark, sf_dir):
    """The model's features as the assembler packs them (before scaling), unpacked by name."""
    flows = EV.load_flows(spark, sf_dir).drop("label_index")
    feats = flow_features(flows)
    raw = ML.assembler(feats).transform(flows).select("kafka_key", vector_to_array(ML.RAW_FEATURES).alias("v"))
    return raw.select("kafka_key", *[F.col("v")[i].alias(f) for i, f in enumerate(feats)])


def _embedding_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return ML.with_vector(e, "embedding", "vec").withColumn("label_name", F.col("label").cast("string"))


@register("train_rf")
def q_train_rf(spark, sf_dir):
    """Random forest with the reference search grid, 3-fold CV on F1."""
    data = _embedding_frame(spark, sf_dir)
    pipe = ML.feature_pipeline(None, "label_name", vector_col="vec").fit(data)
    cv = ML.rf_cross_validator().fit(pipe.transform(data))
    rows = [(int(p["numTrees"]), int(p["maxDepth"]), round(m, 6)) for p, m in ML.cv_metrics(cv)]
    best = cv.bestModel
    return spark.createDataFrame(rows, "num_trees int, max_depth int, avg_f1 double").withColumn(
        "is_best", (F.col("num_trees") == best.getNumTrees) & (F.col("max_depth") == best.getMaxDepth())
    )


@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    """Gradient-boosted trees (xgboost when installed, else one-vs-rest GBT), F1 on a
    held-out fifth of the rows (by a hash of vec_id)."""
    data = _embedding_frame(spark, sf_dir)
    held_out = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    pipe = ML.feature_pipeline(None, "label_name", vector_col="vec").fit(data.filter(~held_out))
    feats = pipe.transform(data)
    name, est = ML.gbt_estimator()
    model = est.fit(feats.filter(~held_out))
    f1 = ML.f1_evaluator().evaluate(model.transform(feats.filter(held_out)))
    return spark.createDataFrame([(name, ML.GBT_MAX_DEPTH[0], ML.GBT_ESTIMATORS[0], round(f1, 6))],
                                 "model string, max_depth int, n_estimators int, f1 double")


@register("confidence")
def q_confidence(spark, sf_dir):
    """Confidence = largest class probability of a forest's probability vector."""
    from pyspark.ml.classification import RandomForestClassifier

    data = _embedding_frame(spark, sf_dir)
    pipe = ML.feature_pipeline(None, "label_name", vector_col="vec").fit(data)
    feats = pipe.transform(data)
    rf = RandomForestClassifier(featuresCol=ML.FEATURES, labelCol=ML.LABEL_INDEX, numTrees=50, maxDepth=5,
                                seed=ML.CV_SEED).fit(feats)
    return rf.transform(feats).select("vec_id", X.max_probability("probability").alias("confidence"))


@register("score_flows")
def q_score_flows(spark, sf_dir):
    root = scratch_path(spark, "score-flows")
    bundle = train_flow_model(spark, sf_dir, root)
    flows = EV.load_flows(spark, sf_dir, training_tasks(spark, read_table(spark, sf_dir, "events").count())).drop("label_index")
    scored = bundle.score(flows)
    return scored.select("kafka_key", "source_ip", "Label", "predicted_attack", "confidence", "model_name", "risk_score")


def _put_messages(msgs: DataFrame, path: str, file_rows: int) -> None:
    """Append messages to a folder. The whole record's formulas and its JSON make one generated method that is too
    long for the JVM to compile (above 8,000 bytes); with the limit there, Spark cuts the formulas into short ones."""
    with settings(msgs.sparkSession, {"spark.sql.codegen.hugeMethodLimit": "8000"}):
        msgs.write.mode("append").option("maxRecordsPerFile", file_rows).parquet(path)


def _write_messages(spark: SparkSession, sf_dir: str, path: str, malformed: bool = False) -> int:
    """Write every flow as messages into a plain folder of several files, with ``malformed`` the
    text of every 89th event with a second opening bracket. Returns the bytes of a micro-batch
    that make several of them."""
    events = read_table(spark, sf_dir, "events")
    n = events.count()
    rows = -(-n // FILES)
    msgs = to_messages(EV.flows_from_events(events, tasks=EV.tasks_for(n, MESSAGE_TASKS)), WIRE_FIELDS)
    if malformed:
        event = F.substring_index("key", "-", -1).cast("long")
        msgs = msgs.withColumn("value", F.when(event % 89 == 0, F.concat(F.lit("{"), "value")).otherwise(F.col("value")))
    _put_messages(msgs, path, max(1, min(FILE_ROWS, rows)))
    return max(1, folder_bytes(spark, path) // EPOCHS)


def _slice_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the messages of one of ``EPOCHS`` slices of time."""
    return EV.tasks_for(-(-read_table(spark, sf_dir, "events").count() // EPOCHS), MESSAGE_TASKS // EPOCHS)


def _write_deliveries(spark: SparkSession, sf_dir: str, path: str) -> tuple[int, str]:
    """Write every flow as messages in slices of time, one after another, each with a second
    delivery of the slice before (and the last one's own behind it), as an at-least-once topic
    is read in order. Returns the bytes of a micro-batch, and the watermark: the longest slice,
    so the state holds the keys of a few slices, however long the topic."""
    msgs = to_messages(EV.load_flows(spark, sf_dir, _slice_tasks(spark, sf_dir)), WIRE_FIELDS)
    at = F.unix_micros("timestamp")
    cuts = msgs.select(at.cast("double").alias("t")).approxQuantile("t", [i / EPOCHS for i in range(EPOCHS + 1)], 0.01)
    edges = [None, *cuts[1:-1], None]

    def slice_of(i: int) -> DataFrame:
        part = msgs
        if edges[i] is not None:
            part = part.filter(at >= F.lit(int(edges[i])))
        return part if edges[i + 1] is None else part.filter(at < F.lit(int(edges[i + 1])))

    for i in range(EPOCHS + 1):
        now = [slice_of(k) for k in (i, i - 1) if 0 <= k < EPOCHS]
        _put_messages(now[0] if len(now) == 1 else now[0].unionByName(now[1]), path, FILE_ROWS)
    bounds = spark.read.parquet(path).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if bounds["lo"] is None:
        return 1, "1 seconds"
    edges = [bounds["lo"], *map(int, cuts[1:-1]), bounds["hi"]]
    span = max(b - a for a, b in zip(edges, edges[1:]))
    return max(1, folder_bytes(spark, path) // EPOCHS), f"{span // 1_000_000 + 2} seconds"


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_stream(spark: SparkSession, sf_dir: str, dedup: bool = False, scorer=None, clock=None, alert_topic=None,
               root: str | None = None, malformed: bool = False) -> SP.Sinks:
    """The job over all flows as messages, in several micro-batches; scored by ``scorer`` if given, else by a
    forest trained on the flows. With ``root`` it goes on where an earlier call with it was stopped."""
    again, root = root is not None and folder_bytes(spark, f"{root}/source") > 0, root or scratch_path(spark, "stream")
    span = None
    if again:
        size = max(1, folder_bytes(spark, f"{root}/source") // EPOCHS)
    elif dedup:
        size, span = _write_deliveries(spark, sf_dir, f"{root}/source")
    else:
        size = _write_messages(spark, sf_dir, f"{root}/source", malformed)
    scorer = scorer or train_flow_model(spark, sf_dir, f"{root}/models").score
    sinks = SP.Sinks(f"{root}/tables")
    stream = SP.file_stream(spark, f"{root}/source", max_bytes_per_trigger=size)
    flows = SP.parsed_flows(stream, dedup_watermark=span)
    _finished(SP.start(flows, SP.BatchProcessor(sinks, scorer, clock=clock, alert_topic=alert_topic), f"{root}/checkpoint", available_now=True))
    return sinks


def _run_checked(spark: SparkSession, sf_dir: str, **options) -> SP.Sinks:
    """The job with the fixed scorer of the wire fields and the message time as its clock, so SQL can restate it."""
    return run_stream(spark, sf_dir, scorer=EV.score_wire_flows, clock=lambda: F.col("kafka_timestamp"), **options)


@register("stream_scored")
def q_stream_scored(spark, sf_dir):
    """The predictions table after the stream."""
    sinks = _run_checked(spark, sf_dir)
    preds = SP.read_committed(spark, sinks, sinks.predictions)
    return preds.select("kafka_key", "source_ip", "predicted_attack", "confidence", "risk_score", "sensor_id", "created_at")


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """The alerts table after the stream."""
    sinks = _run_checked(spark, sf_dir)
    return SP.read_committed(spark, sinks, sinks.alerts).drop("epoch_id")


class _FailsOnce:
    """An alert topic that breaks down in its second epoch, once: the epoch's other sinks are written by then."""

    def __init__(self, sinks: SP.Sinks):
        self.topic, self.calls = FileTopic(sinks.alert_messages), 0

    def publish(self, messages: DataFrame, epoch_id: int | None = None) -> None:
        self.calls += 1
        if self.calls == 2:
            raise ConnectionError("the topic is gone")
        self.topic.publish(messages, epoch_id)


def run_interrupted(spark: SparkSession, sf_dir: str) -> tuple[SP.Sinks, tuple[int, int]]:
    """The job stopped between two sinks of an epoch and started again. Also returns the epochs
    that readers see, and those that the predictions hold, in between."""
    root = scratch_path(spark, "stream")
    sinks = SP.Sinks(f"{root}/tables")
    try:
        _run_checked(spark, sf_dir, alert_topic=_FailsOnce(sinks), root=root)
    except Exception:  # the stream's failure, whatever Spark wraps it in
        pass
    epochs = [df.select("epoch_id").distinct().count() for df in (SP.read_committed(spark, sinks, sinks.predictions), spark.read.parquet(sinks.predictions))]
    _run_checked(spark, sf_dir, root=root)
    return sinks, (epochs[0], epochs[1])


@register("stream_recovered")
def q_stream_recovered(spark, sf_dir):
    """The alerts table after a stream that broke down between two sinks and was started again."""
    sinks, _ = run_interrupted(spark, sf_dir)
    return SP.read_committed(spark, sinks, sinks.alerts).drop("epoch_id")


@register("stream_attackers")
def q_stream_attackers(spark, sf_dir):
    """Attacker profiles read back from the stream's deltas."""
    from flowrisk.operators.profiles import profiles_for_check

    return profiles_for_check(SP.read_profiles(spark, _run_checked(spark, sf_dir)))


def _ingest(spark, sf_dir):
    root = scratch_path(spark, "ingest")
    size = _write_messages(spark, sf_dir, f"{root}/source")
    out = f"{root}/flows"
    flows = SP.parsed_flows(SP.file_stream(spark, f"{root}/source", max_bytes_per_trigger=size))
    q = (flows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q, out


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    _, out = _ingest(spark, sf_dir)
    return spark.read.parquet(out)


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    """Counters of every micro-batch of the stream, from its batch log."""
    return SP.progress_frame(spark, _run_checked(spark, sf_dir))


@register("stream_counters")
def q_stream_counters(spark, sf_dir):
    """What the writes of all micro-batches counted, beside the rows that their sinks hold;
    some messages are malformed."""
    sinks = _run_checked(spark, sf_dir, malformed=True)
    totals = SP.progress_frame(spark, sinks).agg(*[F.sum(c).alias(c) for c in ("published", "failed", "input_rows", "high_risk", "alerts_sent")])
    for name, path in (("scored_rows", sinks.predictions), ("malformed_rows", sinks.quarantine), ("alert_rows", sinks.alerts), ("message_rows", sinks.alert_messages)):
        totals = totals.withColumn(name, F.lit(SP.read_committed(spark, sinks, path).count()).cast("bigint"))
    return totals


@register("stream_pipeline")
def q_stream_pipeline(spark, sf_dir):
    sinks = run_stream(spark, sf_dir)
    return SP.read_committed(spark, sinks, sinks.predictions).drop("event")


@register("stream_profiles")
def q_stream_profiles(spark, sf_dir):
    """Profiles after the stream, read from the segments that its batches merged (several
    epochs make at least one merged segment)."""
    from flowrisk.operators.profiles import profiles_for_check

    sinks = _run_checked(spark, sf_dir)
    log = SP.commits(spark, sinks)
    if log.last() + 1 >= log.fanout and not any(level for level, *_ in log.segments("profiles")):
        raise RuntimeError("the stream merged no segments")
    return profiles_for_check(SP.read_profiles(spark, sinks))


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """Predictions of a topic that delivers every message twice, the second time in a later micro-batch."""
    sinks = _run_checked(spark, sf_dir, dedup=True)
    return SP.read_committed(spark, sinks, sinks.predictions).select("kafka_key", "predicted_attack", "risk_score")


# --- aggregates that a stream keeps live ---------------------------------------------------------


def run_live_profiles(spark: SparkSession, sf_dir: str) -> SL.ProfileStates:
    """Profiles of all flows as messages, kept on the state store: the first half of the files, then,
    started again from its checkpoint, the others."""
    root = scratch_path(spark, "live-profiles")
    sinks = SL.ProfileStates(f"{root}/profiles")
    events = read_table(spark, sf_dir, "events")
    n = events.count()
    msgs = to_messages(EV.flows_from_events(events, tasks=EV.tasks_for(n, MESSAGE_TASKS)), WIRE_FIELDS)
    file_rows = max(1, min(FILE_ROWS, -(-n // FILES)))
    second = F.crc32("key") % 2 == 0
    for part in (msgs.filter(~second), msgs.filter(second)):
        _put_messages(part, f"{root}/source", file_rows)
        size = max(1, folder_bytes(spark, f"{root}/source") // EPOCHS)
        flows = SP.parsed_flows(SP.file_stream(spark, f"{root}/source", max_bytes_per_trigger=size))
        scored = EV.score_wire_flows(flows.filter(~F.col("is_corrupt"))).withColumn("created_at", F.col("kafka_timestamp"))
        _finished(sinks.start(scored, f"{root}/checkpoint", available_now=True))
    return sinks


@register("stream_live_profiles")
def q_stream_live_profiles(spark, sf_dir):
    """Attacker profiles from a streaming aggregation in update mode, across a restart."""
    from flowrisk.operators.profiles import profiles_for_check

    return profiles_for_check(run_live_profiles(spark, sf_dir).read(spark))


def run_timeline(spark: SparkSession, sf_dir: str) -> SL.Timeline:
    """The timeline of all flows as messages. They come in slices of time, in order; one in twenty is held
    back and comes when all others have been read. The allowed delay is the length of a slice, a
    quarter of the whole time, so of those held back the ones of the last quarter are still in time."""
    root = scratch_path(spark, "timeline")
    flows = EV.load_flows(spark, sf_dir, _slice_tasks(spark, sf_dir))
    at = F.unix_micros("kafka_timestamp")
    ends = flows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    delay = (hi - lo) // EPOCHS + 1
    held = F.coalesce(F.col("k") % 20 == 7, F.lit(False)) & (at < F.lit(hi))
    sink = SL.Timeline(f"{root}/timeline", delay, "kafka_timestamp")

    def deliver(rows: DataFrame) -> None:
        _put_messages(to_messages(rows, WIRE_FIELDS), f"{root}/source", FILE_ROWS)

    def read_on() -> None:
        size = max(1, folder_bytes(spark, f"{root}/source") // EPOCHS)
        flows = SP.parsed_flows(SP.file_stream(spark, f"{root}/source", max_bytes_per_trigger=size))
        _finished(sink.start(flows.select("kafka_key", "kafka_timestamp"), f"{root}/checkpoint", available_now=True))

    for i in range(EPOCHS):
        deliver(flows.filter(~held & (at >= F.lit(lo + i * delay)) & (at < F.lit(lo + (i + 1) * delay))))
    read_on()
    deliver(flows.filter(held))
    read_on()
    return sink


@register("stream_timeline")
def q_stream_timeline(spark, sf_dir):
    """Rows of every hour that came in time, and those that came late."""
    sink = run_timeline(spark, sf_dir)
    late = sink.late(spark).groupBy(F.date_trunc("hour", "kafka_timestamp").alias("timestamp")).agg(F.count(F.lit(1)).alias("late"))
    zero = F.lit(0).cast("bigint")
    both = sink.read(spark).withColumn("late", zero).unionByName(late.withColumn("count", zero))
    return both.groupBy("timestamp").agg(F.sum("count").cast("bigint").alias("count"), F.sum("late").cast("bigint").alias("late"))


# --- topic read by offsets -----------------------------------------------------------------------

TOPIC_PARTITIONS = 3


def load_topic(spark: SparkSession, sf_dir: str) -> OffsetTopic:
    """All flows as messages in a topic of three partitions, in two appends."""
    topic = OffsetTopic(spark, scratch_path(spark, "topic"))
    msgs = to_messages(EV.load_flows(spark, sf_dir), WIRE_FIELDS)
    number = F.substring_index("key", "-", -1).cast("bigint")
    for part in (number % 4 != 0, number % 4 == 0):
        topic.append(msgs.filter(part), (number % TOPIC_PARTITIONS).cast("int"))
    return topic


@register("topic_read")
def q_topic_read(spark, sf_dir):
    """The middle half of each partition, by start and end offsets."""
    topic = load_topic(spark, sf_dir)
    ends = topic.ends()
    found = topic.read({p: n // 4 for p, n in ends.items()}, {p: 3 * n // 4 for p, n in ends.items()})
    return found.select(F.col("partition").alias("topic_partition"), F.col("offset").alias("topic_offset"), "key", "timestamp")


# --- dated tables ------------------------------------------------------------------------------


def load_raw_by_date(spark: SparkSession, sf_dir: str) -> DatedTable:
    """Raw telemetry by date and sensor, loaded in two parts that share dates and keys."""
    raw = TB.raw_rows(EV.load_flows(spark, sf_dir))
    table = DatedTable(spark, scratch_path(spark, "raw"), "event_time", ("sensor_id",), ("sensor_id", "event_time"), ("arrival", "kafka_key"))
    late = F.crc32("kafka_key") % 4 == 0
    table.append(raw.filter(~late))
    table.append(raw.filter(late))
    return table


@register("raw_by_date")
def q_raw_by_date(spark, sf_dir):
    """The raw table by date and sensor, as a whole: last write wins also across loads."""
    return load_raw_by_date(spark, sf_dir).read().drop("arrival", "kafka_key")


@register("recent_events_by_date")
def q_recent_events_by_date(spark, sf_dir):
    """Newest 100 events of a sensor, from the newest dates that hold as many."""
    return load_raw_by_date(spark, sf_dir).recent(100, cluster_value="sensor-01").drop("arrival", "kafka_key")


def load_predictions_by_date(spark: SparkSession, sf_dir: str) -> DatedTable:
    table = DatedTable(spark, scratch_path(spark, "predictions"), "created_at")
    table.append(EV.load_scored(spark, sf_dir).select("kafka_key", "source_ip", "predicted_attack", "confidence", "risk_score", "created_at"))
    return table


@register("predictions_seek")
def q_predictions_seek(spark, sf_dir):
    """Page 200 of all predictions by its cursor, the last row of page 199: both pages' cost is that of the first."""
    table = load_predictions_by_date(spark, sf_dir)
    size, page = 20, 200
    last = TB.predictions_page(EV.load_scored(spark, sf_dir), page=page - 1, page_size=size).orderBy(F.desc("row_number")).select("created_at", "kafka_key").first()
    return table.recent(size, key_col="kafka_key", before=(last["created_at"], last["kafka_key"]) if last else None)


#: Days after the newest event at which the sweeps run, so that part of the rows has expired.
PREDICTIONS_SWEPT, REPORTS_SWEPT = 80, 170


@register("retention_sweep")
def q_retention_sweep(spark, sf_dir):
    """Rows of the dated tables that their sweeps leave: predictions after 90 days, anomaly
    reports (one for each alert) after 180."""
    now = as_of_col(spark, sf_dir)
    predictions = load_predictions_by_date(spark, sf_dir)
    predictions.sweep(now + F.make_interval(days=F.lit(PREDICTIONS_SWEPT)), S.PREDICTION_RETENTION_DAYS * 86400)
    reports = DatedTable(spark, scratch_path(spark, "anomaly-reports"), "created_at")
    alerts = AL.to_alerts(EV.load_scored(spark, sf_dir), S.RISK_ALERT_THRESHOLD)
    reports.append(alerts.select(F.lit("open").alias("status"), "source_ip", F.col("alert_id"), F.col("timestamp").alias("created_at")))
    reports.sweep(now + F.make_interval(days=F.lit(REPORTS_SWEPT)), S.ANOMALY_REPORT_RETENTION_DAYS * 86400)
    return (predictions.read().select(F.lit("predictions").alias("table_name"), F.col("kafka_key").alias("id"), "source_ip", "created_at")
            .unionByName(reports.read().select(F.lit("anomaly_reports").alias("table_name"), F.col("alert_id").alias("id"), "source_ip", "created_at")))


def _part_files(spark: SparkSession, flows: DataFrame, path: str, files: int = FILES) -> None:
    """Flows as several part files."""
    rows = -(-flows.count() // files)
    flows.write.option("maxRecordsPerFile", max(1, min(FILE_ROWS, rows))).parquet(path)


@register("contract_footers")
def q_contract_footers(spark, sf_dir):
    """Rows and nulls of every column of the flows, from their part files' footers."""
    path = scratch_path(spark, "parts")
    _part_files(spark, EV.load_flows(spark, sf_dir), path)
    return FT.totals(FT.file_facts(spark, path)).select("column_name", "row_count", "null_count", "critical")


@register("contract_files")
def q_contract_files(spark, sf_dir):
    """Verdicts of part files, summed up by their sensor's folder: one sensor's files lack a
    column, another's hold one as a wider type, and some critical fields are null."""
    path = scratch_path(spark, "parts")
    declared = dict(S.FLOW_COLUMNS)
    flows = EV.load_flows(spark, sf_dir).withColumn("Flow Duration", X.col("Flow Duration").cast(declared["Flow Duration"]))
    shapes = {
        "sensor-01": flows.withColumn("Label", F.when(F.col("event_time").isNotNull() & (F.col("k") % 10 != 3), F.col("Label"))),
        "sensor-02": flows.drop("Flow Duration"),
        "sensor-03": flows.withColumn("Destination Port", X.col("Destination Port").cast("bigint")),
    }
    for sensor, shaped in shapes.items():
        _part_files(spark, shaped.filter(F.col("sensor_id") == sensor), f"{path}/{sensor}", files=3)
    v = FT.verdicts(FT.file_facts(spark, path), S.FLOW_SCHEMA)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ", ")
    return v.groupBy(F.element_at(F.split("file", "/"), -2).alias("folder")).agg(
        F.sum("row_count").alias("row_count"), listed("missing").alias("missing"), listed("other_type").alias("other_type"),
        F.sum("critical_nulls").alias("critical_nulls"), F.bool_and("contract_ok").alias("contract_ok"))


@register("prediction_variants")
def q_prediction_variants(spark, sf_dir):
    """Prediction documents of three record shapes in one table of variants, read back by path."""
    path = scratch_path(spark, "variants")
    docs = TB.prediction_docs(EV.load_scored(spark, sf_dir))
    event = docs.schema["event"].dataType.fieldNames()

    def shaped(sensor: str, *fields) -> DataFrame:
        own = docs.filter(F.col("sensor_id") == sensor)
        return own.withColumn("event", F.struct(*fields)) if fields else own

    field = lambda c: F.col("event")[c].alias(c)
    VR.variant_docs(shaped("sensor-01")).write.parquet(path)
    VR.variant_docs(shaped("sensor-02", *[field(c) for c in event[:4]], F.array(field("k"), F.lit(-1)).alias("seen"))).write.mode("append").parquet(path)
    VR.variant_docs(shaped("sensor-03", field("kafka_key"), F.col("event")["Destination Port"].cast("string").alias("Destination Port"),
                           F.struct(field("k")).alias("props"))).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    return back.select(
        "sensor_id", "predicted_attack", "risk_score", "created_at",
        VR.event_field("kafka_key", "string").alias("kafka_key"),
        VR.event_field("Destination Port", "int").alias("destination_port"),
        VR.event_field("Flow Duration", "bigint").alias("flow_duration"),
        VR.event_field(EV.NULLABLE, dict(S.FLOW_COLUMNS)[EV.NULLABLE]).cast("double").alias("nullable_field"),
        F.coalesce(VR.event_field("k", "int"), VR.event_field(["seen", 0], "int"), VR.event_field(["props", "k"], "int")).alias("k"),
    )

"""Spark ML: feature pipeline, classifiers, model loading with fallback, scoring.

Training and scoring are Spark ML estimators/transformers, so they distribute
like any other plan; nothing is collected except fitted model metadata.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.operators.enrich import score_predictions

LOG = logging.getLogger(__name__)

LABEL_INDEX = "label_index"
RAW_FEATURES = "features_raw_sel"
FEATURES = "features_selected"

# Search grids and fold count of the trained classifiers.
RF_NUM_TREES = [50, 100]
RF_MAX_DEPTH = [5, 10]
GBT_MAX_DEPTH = [5, 10]
GBT_ESTIMATORS = [50, 100]
CV_FOLDS = 3
CV_SEED = 42


def assembler(features: list[str], handle_invalid: str = "keep") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=RAW_FEATURES, handleInvalid=handle_invalid)


def feature_pipeline(features: list[str] | None, label_col: str = "Label", vector_col: str | None = None,
                     handle_invalid: str = "keep") -> Pipeline:
    """Label indexer -> assembler over named columns (or a ready vector) -> scaler.

    ``handle_invalid``: ``keep`` turns null/NaN features into NaN, ``skip``
    drops such rows, ``error`` fails the job.
    """
    stages = [StringIndexer(inputCol=label_col, outputCol=LABEL_INDEX, handleInvalid="keep")]
    if vector_col is None:
        stages.append(assembler(features or [], handle_invalid))
        scaled_in = RAW_FEATURES
    else:
        scaled_in = vector_col
    stages.append(StandardScaler(inputCol=scaled_in, outputCol=FEATURES, withMean=False, withStd=True))
    return Pipeline(stages=stages)


def with_vector(df: DataFrame, array_col: str, out: str = "vec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=LABEL_INDEX, predictionCol="prediction", metricName="f1")


def rf_cross_validator(parallelism: int = 2) -> CrossValidator:
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL_INDEX, seed=CV_SEED)
    grid = ParamGridBuilder().addGrid(rf.numTrees, RF_NUM_TREES).addGrid(rf.maxDepth, RF_MAX_DEPTH).build()
    return CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=f1_evaluator(), numFolds=CV_FOLDS,
                          seed=CV_SEED, parallelism=parallelism)


def gbt_estimator(max_depth: int = GBT_MAX_DEPTH[0], n_estimators: int = GBT_ESTIMATORS[0]):
    """Multiclass gradient-boosted trees.

    Uses ``xgboost.spark.SparkXGBClassifier`` when it is installed; otherwise
    one-vs-rest over Spark's binary ``GBTClassifier``, whose margins give the
    confidence when it is scored (it has no ``probability`` column).
    """
    try:  # optional dependency
        from xgboost.spark import SparkXGBClassifier  # type: ignore

        return "xgboost", SparkXGBClassifier(features_col=FEATURES, label_col=LABEL_INDEX, max_depth=max_depth,
                                             n_estimators=n_estimators)
    except Exception:  # noqa: BLE001
        gbt = GBTClassifier(featuresCol=FEATURES, labelCol="label", maxDepth=max_depth, maxIter=n_estimators,
                            seed=CV_SEED)
        return "gbt_one_vs_rest", OneVsRest(classifier=gbt, featuresCol=FEATURES, labelCol=LABEL_INDEX, parallelism=8)


def cv_metrics(cv_model: CrossValidatorModel) -> list[tuple[dict, float]]:
    maps = cv_model.getEstimatorParamMaps()
    return [({p.name: v for p, v in m.items()}, float(s)) for m, s in zip(maps, cv_model.avgMetrics)]


@dataclass
class ModelBundle:
    feature_pipeline: PipelineModel
    classifier: object
    classifier_name: str
    labels: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Features -> class -> label, confidence, model name, risk; ML columns dropped."""
        out = self.classifier.transform(self.feature_pipeline.transform(df))
        return score_predictions(out, self.labels, self.classifier_name)


def indexer_labels(pipeline_model: PipelineModel) -> list[str]:
    for st in pipeline_model.stages:
        if isinstance(st, StringIndexerModel):
            return list(st.labels)
    return []


def _missing(exc: Exception) -> bool:
    """Whether a load failed because nothing, or a model of another class, is saved there; a
    storage fault is not that, and must not select another model."""
    return any(x in str(exc) for x in ("PATH_NOT_FOUND", "Expected class name"))


def load_models(feature_path: str, primary_path: str, fallback_path: str, label_path: str | None = None) -> ModelBundle:
    """The feature pipeline with the first classifier that is saved: the cross-validated primary
    one, the cross-validated forest, the bare forest. Raises what keeps a saved one from loading."""
    pipe = PipelineModel.load(feature_path)
    labels = list(StringIndexerModel.load(label_path).labels) if label_path else indexer_labels(pipe)
    candidates = [
        ("xgboost", primary_path, lambda p: CrossValidatorModel.load(p).bestModel),
        ("random_forest", fallback_path, lambda p: CrossValidatorModel.load(p).bestModel),
        ("random_forest", f"{fallback_path}/bestModel", RandomForestClassificationModel.load),
    ]
    absent = []
    for name, path, load in candidates:
        try:
            return ModelBundle(pipe, load(path), name, labels)
        except Exception as exc:  # noqa: BLE001
            if not _missing(exc):
                raise
            absent.append(path)
            LOG.info("no %s model at %s", name, path)
    raise RuntimeError(f"none of these holds a saved classifier: {', '.join(absent)}")

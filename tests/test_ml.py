"""Model loading with fallback (primary -> cross-validated forest -> bare best
forest -> error) and scoring through the loaded bundle."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowrisk.operators import ml as ML
from flowrisk.session import scratch_path
from flowrisk.sources.tables import read_table


def _data(spark):
    e = read_table(spark, SF_SMALL, "embeddings")
    return ML.with_vector(e, "embedding", "vec").withColumn("label_name", F.concat(F.lit("c"), F.col("label")))


def _forest():
    return RandomForestClassifier(featuresCol=ML.FEATURES, labelCol=ML.LABEL_INDEX, numTrees=5, maxDepth=3,
                                  seed=ML.CV_SEED)


def test_loader_fallback_chain_and_scoring(spark):
    root = scratch_path(spark, "t-models")
    data = _data(spark)
    pipe = ML.feature_pipeline(None, "label_name", vector_col="vec").fit(data)
    feats = pipe.transform(data)
    pipe.write().overwrite().save(f"{root}/features")

    # nothing saved yet: no classifier can be loaded
    with pytest.raises(RuntimeError):
        ML.load_models(f"{root}/features", f"{root}/primary", f"{root}/forest")

    # only the bare best forest
    _forest().fit(feats).write().overwrite().save(f"{root}/forest/bestModel")
    b = ML.load_models(f"{root}/features", f"{root}/primary", f"{root}/forest")
    assert b.classifier_name == "random_forest"
    assert b.labels == ML.indexer_labels(pipe) and len(b.labels) == 10

    # a cross-validated model in the primary slot wins
    rf = _forest()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=ParamGridBuilder().addGrid(rf.maxDepth, [3]).build(),
                        evaluator=ML.f1_evaluator(), numFolds=2, seed=ML.CV_SEED).fit(feats)
    cv.write().overwrite().save(f"{root}/primary")
    b = ML.load_models(f"{root}/features", f"{root}/primary", f"{root}/forest")
    assert b.classifier_name == "xgboost"

    # a saved model that can't be read is no reason to take another one
    import glob
    for f in glob.glob(f"{root}/primary/metadata/part-*"):
        with open(f, "w") as out:
            out.write("{broken")
    with pytest.raises(Exception) as failed:
        ML.load_models(f"{root}/features", f"{root}/primary", f"{root}/forest")
    assert "none of these holds" not in str(failed.value)

    scored = b.score(data)
    cols = set(scored.columns)
    assert {"predicted_attack", "confidence", "model_name", "risk_score"} <= cols
    assert not ({"rawPrediction", "probability", ML.FEATURES} & cols)
    r = scored.agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
                   F.count_if(~F.col("predicted_attack").isin(*b.labels)).alias("unknown"),
                   F.max("risk_score").alias("risk_hi")).first()
    assert r.n == 500 and 0.0 < r.lo <= r.hi <= 1.0 and r.unknown == 0 and r.risk_hi <= 98.0


def test_model_takes_all_features_and_refuses_a_frame_that_lacks_one(spark):
    from flowrisk import schema as S
    from flowrisk.plans.jobs import flow_features
    from flowrisk.sources import events as EV

    flows = EV.load_flows(spark, SF_SMALL)
    assert flow_features(flows) == S.MODEL_FEATURES
    with pytest.raises(ValueError, match="Idle Min"):
        flow_features(flows.drop("Idle Min"))


def test_one_vs_rest_trees_are_scored_by_their_margins(spark):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    data = _data(spark).withColumn("label_name", F.concat(F.lit("c"), (F.col("label") % 3).cast("string")))
    pipe = ML.feature_pipeline(None, "label_name", vector_col="vec").fit(data)
    gbt = GBTClassifier(featuresCol=ML.FEATURES, labelCol="label", maxDepth=2, maxIter=2, seed=ML.CV_SEED)
    ovr = OneVsRest(classifier=gbt, featuresCol=ML.FEATURES, labelCol=ML.LABEL_INDEX)
    bundle = ML.ModelBundle(pipe, ovr.fit(pipe.transform(data).drop("label")), "gbt_one_vs_rest", ML.indexer_labels(pipe))
    scored = bundle.score(data.drop("label"))
    r = scored.agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"),
                   F.count_if(~F.col("predicted_attack").isin(*bundle.labels)).alias("unknown")).first()
    assert r.n == 500 and 1 / 3 <= r.lo <= r.hi <= 1.0 and r.unknown == 0

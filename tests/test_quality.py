"""Weighted F1 from one aggregate equals Spark ML's evaluator."""

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_CHECK
from flowrisk.operators import quality as QL
from flowrisk.sources import events as EV


def test_weighted_f1_equals_evaluator(spark):
    s = EV.load_scored(spark, SF_CHECK).select(F.col("Label").alias("a"), F.col("predicted_attack").alias("p"))
    # "Unknown" occurs only as a prediction: it has no support, but its rows still cost recall elsewhere.
    ours = QL.weighted_f1(s, "a", "p").first()
    names = sorted({r.a for r in s.select("a").distinct().collect()} | {r.p for r in s.select("p").distinct().collect()})
    code = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))])
    both = s.select(code[F.col("a")].alias("label"), code[F.col("p")].alias("prediction"))
    ref = MulticlassClassificationEvaluator(metricName="f1").evaluate(both)
    assert ours.n == 10000
    assert abs(ours.weighted_f1 - ref) < 1e-6


def test_weighted_f1_small_cases(spark):
    df = spark.createDataFrame(
        [("x", "x"), ("x", "y"), ("y", "y"), ("y", "z"), ("z", None)], "a string, p string")
    r = QL.weighted_f1(df, "a", "p").first()
    # x: tp 1, support 2, predicted 1 -> 2/3; y: tp 1, support 2, predicted 2 -> 1/2; z: tp 0 -> 0
    assert r.n == 5
    assert abs(r.weighted_f1 - round((2 * (2 / 3) + 2 * 0.5) / 5, 6)) < 1e-9

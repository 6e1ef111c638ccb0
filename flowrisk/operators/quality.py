"""Classification quality as plain aggregates (confusion counts, weighted F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def weighted_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Support-weighted F1 over the classes that occur as actual labels.

    Each confusion cell (bounded by classes squared) contributes to its actual
    class (support, true positives) and to its predicted class (predicted
    count), so one aggregate over the cells gives every per-class count: one
    scan, no join. A null prediction counts for no class; a class never
    predicted has F1 0; a class only predicted has no support, hence no weight.
    """
    cm = confusion(df, actual, predicted)
    zero = F.lit(0).cast("bigint")
    as_actual = F.struct(F.col("actual").alias("cls"), F.col("count").alias("support"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(zero).alias("tp"),
                         zero.alias("predicted_n"))
    as_pred = F.struct(F.col("predicted").alias("cls"), zero.alias("support"), zero.alias("tp"),
                       F.col("count").alias("predicted_n"))
    cells = cm.select(F.inline(F.when(F.col("predicted").isNull(), F.array(as_actual))
                               .otherwise(F.array(as_actual, as_pred))))
    per = cells.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted_n")])
    f1 = F.when((F.col("support") + F.col("predicted_n")) == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (F.col("support") + F.col("predicted_n")))
    return per.agg(
        F.sum("support").alias("n"),
        F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
    )

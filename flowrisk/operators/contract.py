"""Data-contract checks over a flow table.

The data side is one distributed aggregate (row count, file count, a null
count per column, the distinct labels); the schema side compares column names
and types, which are metadata and tiny, as small DataFrames with set joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowrisk import schema as S
from flowrisk.functions import scalar as X


def columns_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per column of ``df``: name, 1-based position, type."""
    rows = [(f.name, i + 1, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, ordinal int, data_type string")


def features_frame(spark: SparkSession, features: list[str] = S.MODEL_FEATURES) -> DataFrame:
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(features)], "feature string, position int")


def null_counts(df: DataFrame, critical: list[str] = S.CRITICAL_FIELDS) -> DataFrame:
    """Null count of every column in one aggregate, unpivoted to rows."""
    names = df.columns
    wide = df.agg(*[F.count_if(X.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)])
    stacked = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("ordinal"), F.col(f"c{i}").alias("null_count"))
                      for i, c in enumerate(names)])
        ).alias("s")
    ).select("s.*")
    return stacked.withColumn("critical", F.col("column_name").isin(*critical))


def label_values(df: DataFrame, label_col: str = "Label") -> DataFrame:
    """Distinct non-null labels, sorted (distinct is a partial aggregate)."""
    return df.select(X.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct().orderBy("label")


def missing_features(spark: SparkSession, df: DataFrame, features: list[str] = S.MODEL_FEATURES) -> DataFrame:
    """Model features absent from the data, in feature order (left-anti join)."""
    cols = columns_frame(spark, df)
    return (
        features_frame(spark, features)
        .join(F.broadcast(cols), F.col("feature") == F.col("column_name"), "left_anti")
        .orderBy("position")
    )


def non_feature_columns(spark: SparkSession, df: DataFrame, features: list[str] = S.MODEL_FEATURES,
                        label_col: str = "Label") -> DataFrame:
    """Data columns that are neither a feature nor the label, sorted."""
    cols = columns_frame(spark, df).filter(F.col("column_name") != label_col)
    return (
        cols.join(F.broadcast(features_frame(spark, features)), F.col("feature") == F.col("column_name"), "left_anti")
        .select("column_name")
        .orderBy("column_name")
    )


def contract_ok(df: DataFrame, features: list[str] = S.MODEL_FEATURES,
                critical: list[str] = S.CRITICAL_FIELDS) -> DataFrame:
    """True when no feature is missing and no present critical column has a null.

    Missing features are a schema fact; critical nulls come from one aggregate.
    """
    missing = len([f for f in features if f not in df.columns])
    present = [c for c in critical if c in df.columns]
    nulls = F.lit(0).cast("bigint")
    for c in present:
        nulls = nulls + F.count_if(X.col(c).isNull())
    return df.agg(nulls.alias("critical_nulls")).select(
        F.lit(missing).cast("bigint").alias("missing_count"),
        "critical_nulls",
        ((F.lit(missing) == 0) & (F.col("critical_nulls") == 0)).alias("contract_ok"),
    )


def schema_diff(spark: SparkSession, df: DataFrame, declared: StructType = S.FLOW_SCHEMA) -> DataFrame:
    """Declared vs found column types (full outer join on name)."""
    found = columns_frame(spark, df).select("column_name", F.col("data_type").alias("found_type"))
    want = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in declared.fields],
                                 "column_name string, declared_type string")
    j = want.join(found, "column_name", "full_outer")
    status = (
        F.when(F.col("found_type").isNull(), F.lit("missing"))
        .when(F.col("declared_type").isNull(), F.lit("extra"))
        .when(F.col("found_type") != F.col("declared_type"), F.lit("type_mismatch"))
        .otherwise(F.lit("ok"))
    )
    return j.withColumn("status", status).orderBy("column_name")


def contract_document(df: DataFrame, features: list[str] = S.MODEL_FEATURES, critical: list[str] = S.CRITICAL_FIELDS,
                      label_col: str = "Label", source: str | None = None, file_col: str | None = None) -> DataFrame:
    """The whole contract as one row, from one aggregate over the data.

    ``source`` names the data; ``file_col`` holds each row's file, is counted and is
    no column of the record.

    Row count, a null count per column and the label set (a partial
    ``collect_set``: each task holds at most the distinct labels) come from the
    data; names, types, missing features and non-feature columns come from the
    schema.
    """
    names = [c for c in df.columns if c != file_col]
    missing = [f for f in features if f not in names]
    extra = sorted(set(names) - set(features) - {label_col})
    present_critical = [c for c in critical if c in names]
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count_if(X.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    if label_col in names:
        aggs.append(F.array_sort(F.collect_set(X.col(label_col).cast("string"))).alias("label_values"))
    else:
        aggs.append(F.array().cast("array<string>").alias("label_values"))
    aggs.append((F.count_distinct(F.col(file_col)) if file_col else F.lit(None).cast("bigint")).alias("file_count"))
    wide = df.agg(*aggs)
    nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(f"n{i}") for i in range(len(names))]))
    crit = F.map_from_arrays(F.array(*[F.lit(c) for c in present_critical]).cast("array<string>"),
                             F.array(*[F.col(f"n{names.index(c)}") for c in present_critical]).cast("array<bigint>"))
    crit_total = sum((F.col(f"n{names.index(c)}") for c in present_critical), F.lit(0).cast("bigint"))
    lit_arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return wide.select(
        F.lit(source).cast("string").alias("source"),
        F.current_timestamp().alias("generated_at"),
        "file_count",
        "row_count",
        F.lit(len(names)).alias("column_count"),
        lit_arr(names).alias("columns"),
        F.map_from_arrays(lit_arr(names), lit_arr([df.schema[c].dataType.simpleString() for c in names])).alias("dtypes"),
        nulls.alias("null_counts"),
        lit_arr(critical).alias("required_fields"),
        crit.alias("critical_field_nulls"),
        "label_values",
        lit_arr(features).alias("selected_features"),
        F.lit(len(features)).alias("selected_feature_count"),
        lit_arr(missing).alias("missing_selected_features"),
        lit_arr(extra).alias("non_feature_columns"),
        ((F.lit(len(missing)) == 0) & (crit_total == 0)).alias("contract_ok"),
    )


def write_contract(doc: DataFrame, path: str) -> None:
    """Contract document as JSON (one line)."""
    doc.coalesce(1).write.mode("overwrite").json(path)

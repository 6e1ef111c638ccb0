"""Batch scans of the Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one input table; column pruning and filters reach the Parquet reader.
    The schema is that of the files at the time of the read."""
    return spark.read.parquet(table_path(sf_dir, name))

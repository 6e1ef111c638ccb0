"""Training-corpus pipeline over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet in the shared folder and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import cube_mix, decontaminate, kn_langid, simhash_links, suffix_dedup
from flowrisk.llm.common import table
from flowrisk.session import scratch_path

#: The model of the language stage learns from all its rows; its word shingles and bits are those of the SimHash operator.
SHINGLE, MAX_BITS = 3, 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text no learned language accounts for (no letters, or rejected).
    The language that is found fills in a missing lang; a given one stays."""
    columns = docs.columns
    found = kn_langid.detect(docs, kn_langid.train(docs.select("doc_id", "text", "lang"))).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return simhash_links.keep_one(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document with a smaller doc_id holds; a
    document of which nothing is left goes. Characters cut in part go whole."""
    return suffix_dedup.cut(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words taken of each; those of which none are taken go."""
    return cube_mix.apply_mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Models, component search and sampling can't be stated in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Variant events: paths read back equal the typed columns, records of other shapes share the table."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowrisk.operators import tables as TB
from flowrisk.operators import variants as VR
from flowrisk.session import scratch_path
from flowrisk.sources import events as EV


def test_paths_equal_typed_columns(spark):
    docs = TB.prediction_docs(EV.load_scored(spark, SF_SMALL))
    path = scratch_path(spark, "t-variant")
    VR.variant_docs(docs).write.parquet(path)
    back = spark.read.parquet(path)
    fields = docs.schema["event"].dataType.fields
    assert len(fields) > 50
    typed = docs.select("created_at", *[F.col("event")[f.name].alias(f"f{i}") for i, f in enumerate(fields)])
    got = back.select("created_at", *[VR.event_field(f.name, f.dataType.simpleString()).alias(f"f{i}") for i, f in enumerate(fields)])
    assert typed.exceptAll(got).count() == 0 and got.exceptAll(typed).count() == 0


def test_other_shapes_share_the_table(spark):
    path = scratch_path(spark, "t-shapes")
    rows = spark.range(3).select("id", F.lit("a").alias("kind"), F.struct(F.col("id").alias("n"), F.lit("x").alias('we"ird $[0] näme')).alias("event"))
    other = spark.range(2).select("id", F.lit("b").alias("kind"), F.struct(F.lit("text").alias("n"), F.array(F.lit(1), F.lit(7)).alias("list")).alias("event"))
    none = spark.range(1).select("id", F.lit("c").alias("kind"), F.lit(None).cast("struct<n: bigint>").alias("event"))
    for part in (rows, other, none):
        VR.variant_docs(part).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    got = back.select("kind", "id", VR.event_field("n", "bigint").alias("n"), VR.event_field('we"ird $[0] näme', "string").alias("w"),
                      VR.event_field(["list", 1], "int").alias("l"), F.col("event").isNull().alias("none"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("a", i, i, "x", None, False) for i in range(3)] + [("b", i, None, None, 7, False) for i in range(2)] + [("c", 0, None, None, None, True)], key=repr)
    shapes = {r["kind"]: r for r in VR.event_shapes(back, ["kind"]).collect()}
    assert shapes["a"].documents == 3 and "BIGINT" in shapes["a"]["shape"] and "ARRAY" in shapes["b"]["shape"]


def test_names_in_paths():
    assert VR.path_of("a b", 3, "it's", 'x"y') == """$['a b'][3]["it's"]['x"y']"""
    with pytest.raises(ValueError):
        VR.path_of("""both ' and \"""")


def test_empty(spark):
    docs = VR.variant_docs(TB.prediction_docs(EV.load_scored(spark, SF_SMALL)).limit(0))
    assert docs.select(VR.event_field("Label", "string")).count() == 0

"""The data contract from Parquet footers: rows, types and nulls of every part file
without reading its data.

Tasks open the footers of the part files and give one row for each file and column.
Row counts and types are always there; null counts come from the column chunks'
statistics. Where a chunk has none (files written without them, timestamps of 96 bits,
columns inside records), only those columns of only those files are scanned, and so are
files on a storage that the footer reader has no client for.

Defined results: a file that is no Parquet is one row without a column, and its verdict
says unreadable; empty files count no rows; hidden files are passed over as Spark does.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowrisk import schema as S
from flowrisk.functions import scalar as X
from flowrisk.session import scratch_path

FACTS = "file string, row_count long, readable boolean, column_name string, ordinal int, data_type string, null_count long"
_ARROW_FACTS = pa.schema([("file", pa.string()), ("row_count", pa.int64()), ("readable", pa.bool_()), ("column_name", pa.string()),
                          ("ordinal", pa.int32()), ("data_type", pa.string()), ("null_count", pa.int64())])
#: Spark's names of Arrow's types; others keep Arrow's.
_TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "bool": "boolean",
          "string": "string", "large_string": "string", "binary": "binary", "date32[day]": "date"}


def _spark_type(field: pa.Field, physical: str | None) -> str:
    if pa.types.is_timestamp(field.type):
        return "timestamp" if field.type.tz or physical == "INT96" else "timestamp_ntz"
    if pa.types.is_decimal(field.type):
        return f"decimal({field.type.precision},{field.type.scale})"
    return _TYPES.get(str(field.type), str(field.type))


def _opened(path: str):
    """File system and path of a file; None on a storage without a client here."""
    try:
        return pa.fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def footer_rows(file: str, path: str) -> Iterator[tuple]:
    """The facts of one file, a row a column."""
    where = _opened(path)
    if where is None:
        yield file, None, True, None, None, None, None
        return
    try:
        with where[0].open_input_file(where[1]) as f:
            meta = pq.read_metadata(f)
    except pa.ArrowInvalid:  # no Parquet; a fault of the storage raises and is tried again
        yield file, None, False, None, None, None, None
        return
    leaf = 0
    for i, field in enumerate(meta.schema.to_arrow_schema()):
        nulls, physical = None, None
        if pa.types.is_nested(field.type):
            while leaf < meta.num_columns and meta.schema.column(leaf).path.startswith(f"{field.name}."):
                leaf += 1
        else:
            physical = meta.schema.column(leaf).physical_type
            stats = [meta.row_group(g).column(leaf).statistics for g in range(meta.num_row_groups)]
            if all(s is not None and s.has_null_count for s in stats):
                nulls = sum(s.null_count for s in stats)
            leaf += 1
        yield file, meta.num_rows, True, field.name, i + 1, _spark_type(field, physical), nulls


def _footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, path in zip(b.column("file").to_pylist(), b.column("path").to_pylist(), strict=True):
            facts = list(footer_rows(file, path))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*facts, strict=True), _ARROW_FACTS, strict=True)]
                                             if facts else [pa.array([], type=f.type) for f in _ARROW_FACTS], schema=_ARROW_FACTS)


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """file (as a scan names it) and path of the part files under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each part file and column: rows, type and nulls; nulls that the footers
    leave open are counted by a scan."""
    files = part_files(spark, path)
    kept = scratch_path(spark, "footers")
    files.mapInArrow(_footers, FACTS).write.parquet(kept)  # each footer is opened once
    facts = spark.read.parquet(kept)
    # files and columns without statistics: names only, no more than the scan's own listing holds
    lacking = facts.filter("readable and null_count is null").groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type"))).alias("columns"))
    alike: dict[tuple, list[str]] = defaultdict(list)
    for r in lacking.join(files, "file").select("path", "columns").toLocalIterator():
        alike[tuple((c["column_name"], c["data_type"]) for c in r["columns"])].append(r["path"])
    if not alike:
        return facts
    scans = [_scanned(spark, paths, [n for n, _ in columns if n is not None]) for columns, paths in alike.items()]
    counted = reduce(DataFrame.unionByName, scans)
    known = facts.filter("not readable or null_count is not null")
    named = facts.filter("readable and null_count is null and column_name is not null").drop("null_count")
    unopened = facts.filter("readable and column_name is null").select("file")
    filled = named.join(counted.select("file", "column_name", "null_count"), ["file", "column_name"], "left")
    # a file without rows has no nulls, and no row in the scan
    filled = filled.withColumn("null_count", F.coalesce("null_count", F.lit(0)))
    whole = counted.join(unopened, "file", "left_semi")
    return known.unionByName(filled).unionByName(whole.select(*known.columns))


def _scanned(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Facts of files by a scan of ``columns`` (all, if there are none)."""
    df = spark.read.parquet(*paths)
    columns = columns or df.columns
    wide = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(X.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(df.columns.index(c) + 1).alias("ordinal"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("null_count"))
                     for i, c in enumerate(columns)])
    return wide.select("file", "row_count", F.lit(True).alias("readable"), F.inline(each))


def totals(facts: DataFrame, critical: list[str] = S.CRITICAL_FIELDS) -> DataFrame:
    """Rows and nulls of every column over all files that have it."""
    return facts.filter(F.col("column_name").isNotNull()).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
    ).withColumn("critical", F.col("column_name").isin(*critical))


def verdicts(facts: DataFrame, declared: StructType, critical: list[str] = S.CRITICAL_FIELDS) -> DataFrame:
    """The contract's verdict for each part file: declared columns that it lacks or holds as
    another type, nulls in critical ones, and whether it is good."""
    want = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in declared.fields])
    found = facts.groupBy("file").agg(
        F.max("row_count").alias("row_count"), F.bool_and("readable").alias("readable"),
        F.map_from_entries(F.collect_list(F.when(F.col("column_name").isNotNull(), F.struct("column_name", "data_type")))).alias("types"),
        F.coalesce(F.sum(F.when(F.col("column_name").isin(*critical), F.col("null_count"))), F.lit(0)).alias("critical_nulls"),
    )
    names = lambda keep: F.transform(F.filter(want, keep), lambda c: c["name"])
    out = found.select(
        "file", "row_count", "readable",
        names(lambda c: ~F.map_contains_key("types", c["name"])).alias("missing"),
        names(lambda c: F.element_at("types", c["name"]) != c["type"]).alias("other_type"),
        "critical_nulls",
    )
    return out.withColumn("contract_ok", F.col("readable") & (F.size("missing") == 0) & (F.size("other_type") == 0) & (F.col("critical_nulls") == 0))

"""Helpers shared by the operators: input selection, bounded slices, checkpoints."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.session import checkpoint_root

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: cuts lineage, survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def split_of(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to ``limit`` at most, or hold one row."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def byte_sizes(col: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]


def rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near-independent bits from structured keys."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def to_json(x) -> str:
    return json.dumps(x, separators=(",", ":"), sort_keys=True)


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda keep: 0


def trimmed(result=None):
    """``result``, after freed memory has gone back to the system: a Python worker lives on
    between tasks and would keep what its largest task took, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
    return result

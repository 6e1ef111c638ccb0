"""Contract from footers: equal to a scan, files that deviate are named, scans only where statistics lack."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from conftest import SF_SMALL
from flowrisk.operators import contract as CT
from flowrisk.session import scratch_path
from flowrisk.sources import events as EV
from flowrisk.sources import footers as FT

DECLARED = StructType([StructField("a", LongType()), StructField("b", StringType())])


@pytest.fixture
def folder(tmp_path):
    def put(name, table, **options):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        pq.write_table(table, tmp_path / name, **options)

    good = pa.table({"a": pa.array([1, 2, None], pa.int64()), "b": ["x", None, None]})
    put("good.parquet", good, row_group_size=2)
    put("p=1/no statistics.parquet", good, write_statistics=False)
    put("no_b.parquet", pa.table({"a": pa.array([1], pa.int64())}))
    put("other.parquet", pa.table({"a": ["1", "2"], "c": [{"d": 1, "e": [2]}, None], "b": ["x", None]}))
    put("empty.parquet", good.slice(0, 0), write_statistics=False)
    put("full.parquet", pa.table({"a": pa.array([5], pa.int64()), "b": ["z"]}))
    (tmp_path / "torn.parquet").write_bytes(b"PAR1 torn")
    put("_hidden.parquet", good)
    return str(tmp_path)


def facts_of(df):
    return {(r.file.rsplit("/", 1)[-1].replace("%20", " "), r.column_name): (r.row_count, r.data_type, r.null_count) for r in df.collect()}


def test_facts(spark, folder):
    got = facts_of(FT.file_facts(spark, folder))
    for name in ("good.parquet", "no statistics.parquet"):
        assert got[name, "a"] == (3, "bigint", 1) and got[name, "b"] == (3, "string", 2)
    assert got["empty.parquet", "a"] == (0, "bigint", 0)
    assert got["other.parquet", "a"] == (2, "string", 0) and got["other.parquet", "c"][2] == 1  # nested: scanned
    assert got["other.parquet", "b"] == (2, "string", 1)  # its leaf lies behind the record's
    assert ("no_b.parquet", "b") not in got and got["torn.parquet", None] == (None, None, None)
    assert not any("_hidden" in f for f, _ in got)


def test_verdicts_name_the_deviating_files(spark, folder):
    v = {r.file.rsplit("/", 1)[-1].replace("%20", " "): r for r in FT.verdicts(FT.file_facts(spark, folder), DECLARED, ["a"]).collect()}
    assert {f for f, r in v.items() if r.contract_ok} == {"full.parquet", "empty.parquet"}
    assert v["no_b.parquet"].missing == ["b"] and v["other.parquet"].other_type == ["a"]
    assert v["good.parquet"].critical_nulls == v["no statistics.parquet"].critical_nulls == 1
    assert not v["torn.parquet"].readable and v["torn.parquet"].missing == ["a", "b"]


def test_equals_a_scan_of_flows(spark):
    path = scratch_path(spark, "t-footers")
    flows = EV.load_flows(spark, SF_SMALL)
    flows.write.option("maxRecordsPerFile", 150).parquet(path)
    got = FT.totals(FT.file_facts(spark, path))
    files = FT.part_files(spark, path).count()
    assert files > 3 and {r.file_count for r in got.collect()} == {files}
    assert {r.row_count for r in got.collect()} == {flows.count()}
    assert {r.column_name: r.null_count for r in got.collect()} == {r.column_name: r.null_count for r in CT.null_counts(flows).collect()}


def test_files_with_statistics_are_not_scanned(spark, tmp_path):
    """Footers answer even if no page can be decoded: the data between magic and footer is zeroed."""
    pq.write_table(pa.table({"a": pa.array([1, None] * 500, pa.int64()), "b": ["x"] * 1000}), tmp_path / "f.parquet")
    data = bytearray((tmp_path / "f.parquet").read_bytes())
    footer = int.from_bytes(data[-8:-4], "little")
    data[4:-8 - footer] = bytes(len(data) - 12 - footer)
    (tmp_path / "f.parquet").write_bytes(bytes(data))
    assert facts_of(FT.file_facts(spark, str(tmp_path))) == {("f.parquet", "a"): (1000, "bigint", 500), ("f.parquet", "b"): (1000, "string", 0)}


def test_storage_without_a_client_is_scanned(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"a": pa.array([1, None], pa.int64())}), tmp_path / "f.parquet")
    assert list(FT.footer_rows("f", "nosuch://x/f.parquet")) == [("f", None, True, None, None, None, None)]
    whole = FT._scanned(spark, [str(tmp_path / "f.parquet")], [])
    assert facts_of(whole) == {("f.parquet", "a"): (2, "bigint", 1)}
    # as a whole: footers that can't be opened leave every column to the scan
    unopened = spark.createDataFrame([(r.file, None, True, None, None, None, None) for r in FT.part_files(spark, str(tmp_path)).collect()], FT.FACTS)
    monkeypatch.setattr(FT, "_footers", None)
    monkeypatch.setattr(type(unopened), "mapInArrow", lambda self, f, s: unopened)
    assert facts_of(FT.file_facts(spark, str(tmp_path))) == {("f.parquet", "a"): (2, "bigint", 1)}

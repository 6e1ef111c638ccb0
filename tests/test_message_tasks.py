"""How message files are written."""

import pytest
from conftest import SF_SMALL
from flowrisk.plans import jobs as J
from flowrisk.session import scratch_path, settings
from flowrisk.sources import events as EV
from pyspark.sql import DataFrameWriter

LIMIT, SPLITS = "spark.sql.codegen.hugeMethodLimit", "spark.sql.files.minPartitionNum"


def test_settings_are_put_back(spark):
    before = spark.conf.get(LIMIT)
    with pytest.raises(ValueError), settings(spark, {LIMIT: "9000", SPLITS: "5"}):
        assert (spark.conf.get(LIMIT), spark.conf.get(SPLITS)) == ("9000", "5")
        raise ValueError
    assert spark.conf.get(LIMIT) == before and spark.conf.get(SPLITS, None) is None


def test_messages_are_written_by_methods_that_are_compiled(spark, monkeypatch):
    limits, parquet = [], DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        limits.append(spark.conf.get(LIMIT))
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    path = scratch_path(spark, "t-messages")
    J._write_messages(spark, SF_SMALL, path, malformed=True)
    assert limits == ["8000"]
    assert spark.read.parquet(path).count() == EV.load_flows(spark, SF_SMALL).count()

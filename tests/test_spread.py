"""Events in one row group are dealt to tasks; the rows stay the same."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from flowrisk.plans import jobs
from flowrisk.sources import events as EV


def written(folder, nulls=True):
    n = 40_000
    ids = [i // 2 if i % 5 == 0 else i for i in range(n)]
    table = pa.table({
        "event_id": pa.array([None if nulls and i % 1000 == 7 else i for i in ids], pa.int64()),
        "ts": pa.array([1_704_067_200_000_000 + i * 1_000_000 for i in range(n)], pa.timestamp("us")),
        "user_id": pa.array([i % 321 for i in range(n)], pa.int64()),
        "event_type": ["click" if i % 3 else "error" for i in range(n)],
        "value": [float(i % 77) for i in range(n)],
        "props": ['{"k": %d}' % (i % 90) for i in range(n)],
    })
    pq.write_table(table, folder / "events.parquet", row_group_size=n)
    return str(folder)


@pytest.fixture
def one_group(tmp_path):
    return written(tmp_path)


def test_tasks_grow_with_rows():
    assert [EV.tasks_for(n, 240) for n in (0, 12_500, 40_000, 10_000_000, 500_000_000)] == [1, 1, 4, 240, 1000]


def test_spread_flows_are_the_same_rows(spark, one_group):
    plain, spread = EV.load_flows(spark, one_group), EV.load_flows(spark, one_group, 4)
    assert spread.rdd.getNumPartitions() == 4
    assert spread.count() == 40_000 and plain.exceptAll(spread).count() == 0


def test_training_reads_a_row_group_in_several_tasks(spark, tmp_path, monkeypatch):
    """Training and messages on one row group were the work of one task."""
    seen = []
    fit = jobs.ML.Pipeline.fit
    monkeypatch.setattr(jobs.ML.Pipeline, "fit", lambda self, df, *a: (seen.append(df.rdd.getNumPartitions()), fit(self, df, *a))[1])
    monkeypatch.setattr(jobs, "BEST_RF_TREES", 2)
    monkeypatch.setattr(jobs, "BEST_RF_DEPTH", 2)
    jobs.train_flow_model(spark, written(tmp_path, nulls=False), str(tmp_path / "models"))
    assert seen[0] > 1


def test_messages_are_written_by_several_tasks(spark, one_group, tmp_path):
    path = str(tmp_path / "messages")
    jobs._write_messages(spark, one_group, path)
    back = spark.read.parquet(path)
    parts = {f.rsplit("/part-", 1)[1][:5] for f in back.inputFiles()}
    assert len(parts) > 1 and back.count() == 40_000

"""Dated tables: merges by key, sweeps that leave other files alone, newest-first reads and cursors."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from flowrisk.operators import tables as TB
from flowrisk.plans import jobs as J
from flowrisk.session import scratch_path
from flowrisk.sinks.dated import UNDATED, DatedTable
from flowrisk.sources import events as EV


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t string, v bigint").withColumn("t", F.col("t").cast("timestamp"))


def files(table):
    return {f"{d}/{n}" for folders in table.parts().values() for d in folders for n in os.listdir(d) if n.startswith("part")}


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_last_write_wins_across_appends(spark):
    table = DatedTable(spark, scratch_path(spark, "t-dated"), "t", ("k",), ("k", "t"), ("v",))
    table.append(frame(spark, [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:00:00", 3), ("b", "2024-01-02 10:00:00", 5)]))
    before = files(table)
    table.append(frame(spark, [("a", "2024-01-01 10:00:00", 2), ("c", "2024-01-01 11:00:00", 9), ("d", None, 7)]))
    assert values(table.read()) == [3, 5, 7, 9]
    assert {f for f in before if "2024-01-02" in f} <= files(table)  # the untouched date's files stay
    assert sorted(table.parts()) == ["2024-01-01", "2024-01-02", UNDATED] and all(len(f) == 1 for f in table.parts().values())
    table.append(frame(spark, []))
    assert values(table.read()) == [3, 5, 7, 9]
    with pytest.raises(ValueError):
        DatedTable(spark, "x", "t", keys=("k",))


def test_sweep_drops_whole_dates_and_rewrites_the_edge(spark):
    table = DatedTable(spark, scratch_path(spark, "t-sweep"), "t")
    rows = [(str(d), f"2024-01-{d:02} {h:02}:30:00", 100 * d + h) for d in range(1, 11) for h in range(24)] + [("x", None, 7)]
    table.append(frame(spark, rows[:150]))
    table.append(frame(spark, rows[150:]))
    before, reader = files(table), table.read()
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp")
    assert table.sweep(as_of, 5 * 86400) == {"dropped": ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"], "rewritten": ["2024-01-05"]}
    assert values(table.read()) == sorted([7] + [100 * d + h for d in range(5, 11) for h in range(24) if d > 5 or h >= 12])
    assert {f for f in before if any(f"2024-01-{d:02}" in f for d in range(6, 11))} <= files(table)
    assert reader.count() == len(rows)  # a reader of the state before still finds its files
    assert table.sweep(as_of, 5 * 86400) == {"dropped": [], "rewritten": []}
    assert values(table.recent(3)) == [1021, 1022, 1023]
    # an edge that loses all its rows goes, too; the folders of two changes ago are deleted
    table.sweep(F.lit("2024-01-10 23:45:00").cast("timestamp"), 3 * 86400)
    table.sweep(F.lit("2024-01-10 23:50:00").cast("timestamp"), 2 * 86400)
    assert sorted(table.parts()) == ["2024-01-09", "2024-01-10", UNDATED]
    left = {d.split("event_date=")[1] for d, _, names in os.walk(table.path) if "event_date=" in d}
    assert "2024-01-02" not in left
    table.sweep(F.lit("2030-01-01 00:00:00").cast("timestamp"), 1)
    assert values(table.read()) == [7] and table.recent(5).count() == 0


def test_many_appends_merge_a_date(spark):
    table = DatedTable(spark, scratch_path(spark, "t-merge"), "t")
    for i in range(9):
        table.append(frame(spark, [("a", "2024-01-01 10:00:00", i)]))
    assert values(table.read()) == list(range(9)) and len(table.parts()["2024-01-01"]) == 2
    assert values(table.recent(4, key_col="v")) == [5, 6, 7, 8]


def test_cursor_walks_over_ties_and_gaps(spark):
    table = DatedTable(spark, scratch_path(spark, "t-seek"), "t", ("k",))
    rows = [("ab"[i % 2], f"2024-0{1 + i % 3}-1{i % 7} 0{i % 2}:00:00", i) for i in range(90)] + [("a", None, -1)]
    table.append(frame(spark, rows))
    assert DatedTable(spark, f"{table.path}-none", "t").log.newest()[0] == -1
    for value, mine in ((None, rows[:-1]), ("a", [r for r in rows[:-1] if r[0] == "a"])):
        want = [r[2] for r in sorted(mine, key=lambda r: (r[1], r[2]), reverse=True)]
        got, cursor = [], None
        for _ in range(len(want) // 7 + 2):
            page = table.recent(7, key_col="v", cluster_value=value, before=cursor).collect()
            got += [r["v"] for r in page]
            if page:
                cursor = (page[-1]["t"], page[-1]["v"])
        assert got == want


def test_newest_of_a_sensor_opens_the_newest_dates_only(spark):
    table = J.load_raw_by_date(spark, SF_CHECK)
    newest = table.recent(100, cluster_value="sensor-01")
    flows = EV.load_flows(spark, SF_CHECK)
    want = TB.recent_events(TB.raw_upsert(flows), "sensor-01", 100)
    assert sorted(r["event_time"] for r in newest.collect()) == sorted(r["event_time"] for r in want.collect())
    opened = {f.split("event_date=")[1][:10] for f in newest.inputFiles()}
    assert len(table.parts()) == 30 and opened == {"2024-01-30", "2024-01-29"} or len(opened) == 1
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_time), IsNotNull(sensor_id), GreaterThanOrEqual(event_time" in plan


def test_a_late_page_costs_what_the_first_does(spark):
    table = J.load_predictions_by_date(spark, SF_CHECK)
    rows = [(r["created_at"], r["kafka_key"]) for r in EV.load_scored(spark, SF_CHECK).select("created_at", "kafka_key").collect()]
    rows.sort(reverse=True)
    for at in (1000, 9000):
        page = table.recent(20, key_col="kafka_key", before=rows[at - 1])
        assert [(r["created_at"], r["kafka_key"]) for r in page.collect()] == rows[at : at + 20]
        assert len({f.split("event_date=")[1][:10] for f in page.inputFiles()}) <= 2
    assert table.recent(20, key_col="kafka_key", before=rows[-1]).count() == 0

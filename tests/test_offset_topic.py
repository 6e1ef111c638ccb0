"""Topic on shared storage: offsets without gaps, reads that open the files of their range only."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowrisk.plans import jobs as J
from flowrisk.session import scratch_path
from flowrisk.sinks.offset_topic import OffsetTopic
from flowrisk.sinks.version_log import VersionTaken


def messages(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, t string").select("key", "value", F.col("t").cast("timestamp").alias("timestamp"))


def test_offsets_have_no_gaps_and_follow_appends_and_time(spark):
    topic = OffsetTopic(spark, scratch_path(spark, "t-topic"), file_rows=50)
    assert topic.ends() == {} and topic.read({}, {0: 10}).count() == 0
    # partition 0 holds nine in ten messages, and is spread over tasks and files
    first = [(f"k{i:04}", "v", f"2024-01-01 00:{i % 60:02}:00") for i in range(1000)]
    by = F.when(F.substring("key", -1, 1) == "7", 1).otherwise(0)
    topic.append(messages(spark, first).repartition(5), by)
    topic.append(messages(spark, [("late7", "v", "2023-01-01 00:00:00"), (None, None, None), (None, None, None)]), F.coalesce(by, F.lit(2)))
    topic.append(messages(spark, []), by)
    assert topic.ends() == {0: 902, 1: 101} or topic.ends() == {0: 900, 1: 101, 2: 2}
    got = topic.read({}, topic.ends()).orderBy("partition", "offset").collect()
    for p in topic.ends():
        mine = [r for r in got if r["partition"] == p]
        assert [r["offset"] for r in mine] == list(range(topic.ends()[p]))
        old = [(r["timestamp"], r["key"]) for r in mine if r["key"] and r["key"].startswith("k")]
        assert old == sorted(old)
    assert [r["key"] for r in got if r["partition"] == 1][-1] == "late7"  # an append comes behind the ones before
    assert len(topic.files({}, {0: 900})) >= 18


def test_a_read_opens_the_files_of_its_range_only(spark):
    topic = OffsetTopic(spark, scratch_path(spark, "t-range"), file_rows=10)
    topic.append(messages(spark, [(f"k{i:04}", "v", "2024-01-01 00:00:00") for i in range(600)]), F.lit(0))
    every = topic.files({}, {0: 600})
    some = topic.read({0: 100}, {0: 115})
    assert sorted(r["offset"] for r in some.collect()) == list(range(100, 115))
    assert len(some.inputFiles()) <= 4 < 60 <= len(every)
    assert topic.read({0: 5}, {0: 5}).count() == topic.read({0: 600}, {0: 900}).count() == topic.read({}, {7: 3}).count() == 0
    assert topic.read({0: 590}, {0: 10_000}).count() == 10


def test_one_of_two_writers_fails_and_leaves_no_messages(spark):
    path = scratch_path(spark, "t-writers")
    a, b = OffsetTopic(spark, path), OffsetTopic(spark, path)
    a.append(messages(spark, [("a", "v", "2024-01-01 00:00:00")]), F.lit(0))
    stale = a._state()
    b.append(messages(spark, [("b", "v", "2024-01-01 00:00:00")]), F.lit(0))
    a._state = lambda: stale  # a read its state before b wrote
    with pytest.raises(VersionTaken):
        a.append(messages(spark, [("c", "v", "2024-01-01 00:00:00")]), F.lit(0))
    assert [r["key"] for r in b.read({}, b.ends()).orderBy("offset").collect()] == ["a", "b"]


def test_a_message_without_a_partition_is_refused(spark):
    topic = OffsetTopic(spark, scratch_path(spark, "t-null"))
    with pytest.raises(Exception, match="no partition"):
        topic.append(messages(spark, [("a", "v", None)]), F.lit(None).cast("int"))
    assert topic.ends() == {}


def test_topic_of_all_flows(spark):
    topic = J.load_topic(spark, SF_SMALL)
    ends = topic.ends()
    whole = topic.read({}, ends)
    assert whole.count() == sum(ends.values()) == whole.select("partition", "offset").distinct().count() == whole.select("key").distinct().count()

"""A key or a group of copies with a third of all rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from subflow.operators import gate, lists
from subflow.operators.spread import attach_per_key
from subflow.schemas import COLLECTOR_STATUS

N = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one file, and a third of that file one row's copies."""
    i = F.col("id")
    hot = i % 3 == 0
    copy = i % 9 == 0
    return spark.range(0, N, 1, 16).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("f"), i % 4000)).alias("file_name"),
        F.when(copy, F.lit(-1)).otherwise(i).alias("id"),
        F.lit("2021-01-01").cast("date").alias("startDate"),
        F.lit("2021-01-02").cast("date").alias("endDate"),
        F.when(hot & ~copy & (i % 2 == 0), F.lit(400)).otherwise(F.lit(1)).cast("bigint").alias("duration"),
        F.lit(1.0).alias("price"),
    )


def as_counter(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_shuffled_attach_equals_broadcast_attach(spark, skewed):
    per_key = skewed.groupBy("file_name").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    per_key = per_key.filter("file_name != 'f1'")
    for how in ("inner", "left"):
        small = attach_per_key(skewed, per_key, "file_name", "n", how)
        large = attach_per_key(skewed, per_key, "file_name", "n", how, broadcast_bytes=-1)
        assert as_counter(small) == as_counter(large)


def test_hot_rows_and_copies_reach_many_tasks(spark, skewed):
    per_key = skewed.groupBy("file_name").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_per_key(skewed, per_key, "file_name", "n", broadcast_bytes=-1)
        per_task = joined.withColumn("task", F.spark_partition_id())
        hot = per_task.filter("file_name = 'hot'").groupBy("task").count().collect()
        copies = per_task.filter("id = -1").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(hot) == 8 and max(r["count"] for r in hot) < N / 3 / 4
    assert len(copies) > 4 and max(r["count"] for r in copies) < N / 9 / 2


def test_small_side_is_not_shuffled_against(spark, skewed):
    per_key = skewed.groupBy("file_name").agg(F.count("*").alias("n"))
    joined = attach_per_key(skewed, per_key.withColumn("x", F.lit(1)), "file_name", "n")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_gate_marks_by_file(spark, skewed):
    counts = gate.held_counts(skewed)
    statuses = counts.filter("file_name != 'f1'").select(
        "file_name",
        F.when(F.col("file_name") == "f2", F.col("held") + 1).otherwise(F.col("held")).alias("countGoodRecords"),
    )
    for limit in ({}, {"broadcast_bytes": -1}):
        out = gate.gate(skewed, statuses.select(COLLECTOR_STATUS.fieldNames()), **limit)
        assert out.count() == N
        partial = {r.file_name for r in out.filter(~F.col("is_complete")).select("file_name").distinct().collect()}
        assert partial == {"f1", "f2"}


def test_large_lists_come_in_parts_and_whole(spark, skewed):
    built = lists.bucket_lists(skewed, list_rows=1000)
    sizes = built.select("file_name", F.size("list").alias("n")).collect()
    assert sum(r.n for r in sizes) == N
    hot = [r.n for r in sizes if r.file_name == "hot"]
    assert len(hot) >= 15 and max(hot) < 4000
    others = Counter(r.file_name for r in sizes if r.file_name != "hot")
    assert set(others.values()) == {1}
    whole = built.groupBy("file_name", "isMoreYear", "parts").agg(F.count("*").alias("n"))
    assert whole.filter("n > parts").count() == 0
    want = as_counter(lists.stored_items(skewed).drop("file_name"))
    assert as_counter(lists.explode_lists(built)) == want


def test_lists_do_not_depend_on_how_the_rows_are_split(spark, skewed):
    built = [
        as_counter(lists.bucket_lists(rows, list_rows=1000).withColumn("list", F.to_json("list")))
        for rows in (skewed, skewed.orderBy(F.rand(3)).coalesce(3))
    ]
    assert built[0] == built[1]
    copies = lists.bucket_lists(skewed, list_rows=1000).filter("file_name = 'hot'")
    copies = copies.select(F.size(F.filter("list", lambda i: i["id"] == -1)).alias("n")).filter("n > 0")
    assert copies.count() > 4


def test_a_hot_key_that_the_other_side_lacks_reaches_many_tasks(spark, skewed):
    per_key = skewed.filter("file_name != 'hot'").groupBy("file_name").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_key = per_key.withColumn("x", F.lit(1))
        joined = attach_per_key(skewed, per_key, "file_name", "n", "left", broadcast_bytes=-1)
        tasks = joined.filter("file_name = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < N / 3 / 4

"""Rows into a database once: commit, abort and repeated batches, on a database made up for tests."""

import json

import fake_database
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from subflow.schemas import BUCKET_LIST
from subflow.sinks.ledger import LedgerWriter, Tables, store_items_once, store_lists_once

NAMES = {"staging": "staging", "ledger": "ledger", "short": "short", "long": "long"}


@pytest.fixture
def path(spark, tmp_path):
    spark.sparkContext.addPyFile(fake_database.__file__)
    fake_database.create(tmp_path / "db")
    return str(tmp_path / "db")


def tables(path):
    return {name: len(rows) for name, rows in json.loads(open(path).read()).items()}


def items(spark, n):
    days = F.col("id")
    return spark.range(n, numPartitions=5).select(
        (F.col("id") % 3 == 0).alias("isMoreYear"), "id", days.alias("startDate"), (days + 1).alias("endDate"),
        F.lit(1).cast("bigint").alias("duration"), F.lit(2.5).alias("price"),
    )


def test_a_repeated_batch_adds_nothing(spark, path):
    options = {"properties": {"path": path}, "tables": NAMES}
    for _ in range(2):
        store_items_once(items(spark, 30), 4, "fake_database:connect", **options)
        assert tables(path) == {"staging": 0, "ledger": 1, "short": 20, "long": 10}
    lists = spark.createDataFrame([(True, 0, 1, [(1, 10, 410, 400, 1.0)])], BUCKET_LIST)
    store_lists_once(lists, 5, "fake_database:connect", **options)
    assert tables(path) == {"staging": 0, "ledger": 2, "short": 20, "long": 11}
    stored = json.loads(open(path).read())
    assert {"startDate": 10, "endDate": 410, "duration": 400, "price": 1.0} in stored["long"]


def test_a_failed_batch_leaves_nothing(spark, path):
    options = {"properties": {"path": path}, "tables": NAMES}
    bad = items(spark, 30).withColumn("price", F.when(F.col("id") == 29, F.raise_error(F.lit("lost"))).otherwise(1.0))
    with pytest.raises(PySparkException):
        store_items_once(bad, 4, "fake_database:connect", **options)
    assert tables(path)["short"] == tables(path)["long"] == tables(path)["ledger"] == 0
    store_items_once(items(spark, 30), 4, "fake_database:connect", **options)
    assert tables(path) == {"staging": 0, "ledger": 1, "short": 20, "long": 10}


def test_only_the_tries_that_count_are_moved(path):
    """A task that ran twice staged its rows twice; a lost try's rows go with the commit."""
    writer = LedgerWriter(9, "fake_database:connect", {"path": path}, Tables(**NAMES))
    rows = [Row(isMoreYear=i % 2 == 0, startDate=i, endDate=i + 1, duration=1, price=1.0) for i in range(10)]
    lost, counts, other = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter(rows[:2]))
    assert tables(path)["staging"] == 22
    writer.abort([None, other])
    assert tables(path)["staging"] == 20
    writer.commit([counts, None])
    assert tables(path) == {"staging": 0, "ledger": 1, "short": 5, "long": 5}
    again = writer.write(iter(rows))
    writer.commit([again])
    assert tables(path) == {"staging": 0, "ledger": 1, "short": 5, "long": 5} and lost.token != counts.token


def test_a_failed_commit_moves_nothing(path, monkeypatch):
    writer = LedgerWriter(9, "fake_database:connect", {"path": path}, Tables(**NAMES))
    message = writer.write(iter([Row(isMoreYear=True, startDate=1, endDate=2, duration=1, price=1.0)]))
    with monkeypatch.context() as broken:
        broken.setattr(fake_database.Connection, "commit", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            writer.commit([message])
    assert tables(path) == {"staging": 1, "ledger": 0, "short": 0, "long": 0}
    writer.commit([message])
    assert tables(path) == {"staging": 0, "ledger": 1, "short": 0, "long": 1}

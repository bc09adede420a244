"""Stored tables in a database: what is handed to Spark's JDBC writer."""

from pyspark.sql import DataFrameWriter

from subflow.schemas import BUCKET_LIST
from subflow.sinks import jdbc
from subflow.streaming.store import store_stream_jdbc
from subflow.workspace import shared_folder


def test_jdbc_rows_go_to_the_table_of_their_bucket(spark, monkeypatch):
    calls = []

    def record(self, url, table, mode=None, properties=None):
        calls.append((url, table, mode, properties, [tuple(r) for r in self._df.collect()]))

    monkeypatch.setattr(DataFrameWriter, "jdbc", record)
    lists = spark.createDataFrame(
        [(False, 0, 1, [(1, 18628, 18629, 1, 300.0)]), (True, 0, 1, [(2, 18628, 19028, 400, 1.0)])], BUCKET_LIST
    )
    jdbc.store_lists_jdbc(lists, "jdbc:x", {"user": "u", "batchsize": "5"})
    options = {"batchsize": "5", "numPartitions": "16", "user": "u"}
    assert calls == [
        ("jdbc:x", "subscription", "append", options, [(18628, 18629, 1, 300.0)]),
        ("jdbc:x", "longSubscription", "append", options, [(18628, 19028, 400, 1.0)]),
    ]


def test_a_stream_of_lists_goes_to_the_database(spark, monkeypatch, tmp_path):
    calls = []

    def record(self, url, table, mode=None, properties=None):
        calls.append((table, mode, properties["user"], [tuple(r) for r in self._df.collect()]))

    monkeypatch.setattr(DataFrameWriter, "jdbc", record)
    lists = [(False, 0, 1, [(1, 10, 11, 1, 2.5)]), (True, 0, 1, [(2, 10, 410, 400, 1.0)])]
    spark.createDataFrame(lists, BUCKET_LIST).write.parquet(str(tmp_path / "lists"))
    stream = spark.readStream.schema(BUCKET_LIST).parquet(str(tmp_path / "lists"))
    names = {"short_table": "short", "long_table": "long"}
    query = store_stream_jdbc(stream, "jdbc:x", {"user": "u"}, str(tmp_path / "log"), names)
    query.awaitTermination()
    assert calls == [
        ("short", "append", "u", [(10, 11, 1, 2.5)]),
        ("long", "append", "u", [(10, 410, 400, 1.0)]),
    ]


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

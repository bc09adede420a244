"""Published batches as a stream: each batch once and whole, in the order of its number."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from subflow.sinks.manifest import published_files
from subflow.sources.discovery import Found, file_store


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(None)
        self.files = files


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of steps in the log of the manifests found."""

    def __init__(self, options, schema: T.StructType) -> None:
        self.path, self.log, self.columns = options["path"], options["log"], schema.fieldNames()
        self.most = int(options.get("max_batches", 0)) or None
        self.found: Found | None = None

    def _log(self) -> Found:
        if self.found is None:
            self.found = Found(self.log)
        return self.found

    def initialOffset(self) -> dict:
        return {"steps": 0}

    def latestOffset(self) -> dict:
        return {"steps": self._log().next_offset(published_files(self.path), self.most)}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        entries = self._log().between(start["steps"], end["steps"])
        return [_Files([name]) for entry in entries for name in entry["files"]] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, folder = file_store(self.path)
        for name in partition.files:
            with store.open_input_file(f"{folder}/{name}") as file:
                # Only this file's own columns: its folder's name is a column of none.
                yield from pq.ParquetFile(file).iter_batches(columns=self.columns)


class PublishedTable(DataSource):
    """``spark.readStream.format("published_table").schema(...).load(path)``; options ``log``, ``max_batches``."""

    @classmethod
    def name(cls) -> str:
        return "published_table"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def stream_published(
    spark: SparkSession, path: str, schema: T.StructType, log: str, max_batches: int | None = None
) -> DataFrame:
    """The batches now published, then each new one; ``log`` is a folder of this stream's own.

    With ``max_batches``, a micro-batch takes so many; without, all that are there.
    """
    spark.dataSource.register(PublishedTable)
    reader = spark.readStream.format("published_table").schema(schema).option("log", log)
    if max_batches:
        reader = reader.option("max_batches", str(max_batches))
    return reader.load(path)

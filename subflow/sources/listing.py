"""Every file of a folder, from the listing alone: empty ones, and any name.

Spark's file sources pass over empty files and names that begin with ``_`` or ``.``; a
delivery may have any name, and each one gets a verdict. So the listing is a data source
of its own, for batches and streams. No file is opened.

A flat folder's files are all deliveries. In a folder of folders ``file_name=<name>``, as
Spark writes them, the files below are parts, and names with ``_`` or ``.`` in front are
bookkeeping of the job that wrote them.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from subflow.sources.discovery import Found, file_store

# The store is the folder as it was given; a path is one in the store's file system.
SCHEMA = "store string, file_path string, length bigint, modified bigint"
# Names that one task puts out.
NAMES_AT_ONCE = 20_000


class _Names(InputPartition):
    def __init__(self, store: str, entries: list[dict]) -> None:
        super().__init__(None)
        self.store, self.entries = store, entries


def listed(path: str, nested: bool) -> list[dict]:
    """Path, length and modification time of every file, by path."""
    store, folder = file_store(path)
    entries = []
    for info in store.get_file_info(pafs.FileSelector(folder, recursive=nested)):
        if info.type != pafs.FileType.File:
            continue
        if nested and (info.base_name.startswith(("_", ".")) or "/file_name=" not in info.path):
            continue
        # A file that is replaced under its name is not a new delivery.
        modified = (info.mtime_ns or 0) // 1000
        entries.append({"key": info.path, "length": info.size, "modified": modified})
    return sorted(entries, key=lambda entry: entry["key"])


def _dealt(store: str, entries: list[dict]) -> list[_Names]:
    starts = range(0, max(len(entries), 1), NAMES_AT_ONCE)
    return [_Names(store, entries[start : start + NAMES_AT_ONCE]) for start in starts]


def _rows(partition: _Names) -> Iterator[pa.RecordBatch]:
    entries = partition.entries
    columns = [[partition.store] * len(entries), *([e[name] for e in entries] for name in ("key", "length", "modified"))]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, names=["store", "file_path", "length", "modified"])


class _Batch(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.nested = options["path"], options.get("nested") == "true"

    def partitions(self) -> list[_Names]:
        return _dealt(self.path, listed(self.path, self.nested))

    def read(self, partition: _Names) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of steps in the log of what was found."""

    def __init__(self, options) -> None:
        self.path, self.nested, self.log = options["path"], options.get("nested") == "true", options["log"]
        self.most = int(options.get("max_files", 0)) or None
        self.found: Found | None = None

    def _log(self) -> Found:
        if self.found is None:
            self.found = Found(self.log)
        return self.found

    def initialOffset(self) -> dict:
        return {"steps": 0}

    def latestOffset(self) -> dict:
        return {"steps": self._log().next_offset(listed(self.path, self.nested), self.most)}

    def partitions(self, start: dict, end: dict) -> list[_Names]:
        return _dealt(self.path, self._log().between(start["steps"], end["steps"]))

    def read(self, partition: _Names) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class DeliveryListing(DataSource):
    """``spark.read.format("delivery_listing").load(path)``; options ``nested``, for a stream ``log`` and ``max_files``."""

    @classmethod
    def name(cls) -> str:
        return "delivery_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def list_paths(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """``store, file_path, length, modified`` of every file now in a folder."""
    spark.dataSource.register(DeliveryListing)
    return spark.read.format("delivery_listing").option("nested", str(nested).lower()).load(path)


def stream_paths(
    spark: SparkSession, path: str, log: str, nested: bool = False, max_files: int | None = None
) -> DataFrame:
    """The same of the files now in a folder, then of each new one; every path once.

    ``log`` is a folder of the stream's own, in storage that stays, like its checkpoint.
    ``max_files`` bounds a step of the log.
    """
    spark.dataSource.register(DeliveryListing)
    reader = spark.readStream.format("delivery_listing").option("nested", str(nested).lower()).option("log", log)
    if max_files:
        reader = reader.option("max_files", str(max_files))
    return reader.load(path)

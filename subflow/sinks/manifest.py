"""Batches that appear whole: many files, and a manifest that says which.

The tasks of a batch write as many files as they are. Their names become visible under the
batch's folder, and then a manifest with the list of them is given its name, which only one
of several tries can do. Readers take the manifest as the list (:func:`read_published`, and
as a stream ``sources.published``): a try that died, is repeated, or lost against another
one adds nothing. Files that no manifest lists are removed by the try that wins.
"""

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from subflow.sources.discovery import file_store, read_whole, write_whole
from subflow.workspace import exists, move_to, remove, rename_new, visible_files

# Hidden from Spark's readers, as the folder of a try is.
FOLDER = "_manifests"


def manifest_path(path: str, batch_id: int, by: str) -> str:
    return f"{path}/{FOLDER}/{by}={batch_id}.json"


def publish_batch(df: DataFrame, path: str, batch_id: int, by: str) -> None:
    """Publish ``df`` as a batch; if that batch has been published, nothing is written."""
    spark = df.sparkSession
    manifest = manifest_path(path, batch_id, by)
    if exists(spark, manifest):
        return
    attempt = uuid.uuid4().hex
    made, folder = f"{path}/_try-{attempt}", f"{path}/{by}={batch_id}"
    df.write.parquet(made)
    names = []
    for n, source in enumerate(visible_files(spark, made)):
        names.append(f"part-{n:05d}-{attempt}.parquet")
        move_to(spark, source, f"{folder}/{names[-1]}")
    text = json.dumps({by: batch_id, "files": [f"{by}={batch_id}/{name}" for name in names]})
    store, place = file_store(f"{path}/{FOLDER}/.{attempt}")
    write_whole(store, place, text.encode())
    won = rename_new(spark, f"{path}/{FOLDER}/.{attempt}", manifest)
    for other in visible_files(spark, folder):
        if (other.rsplit("/", 1)[1] in names) != won:
            remove(spark, other)
    remove(spark, made)


def is_published(spark: SparkSession, path: str, batch_id: int, by: str) -> bool:
    return exists(spark, manifest_path(path, batch_id, by))


def published_files(path: str) -> list[dict]:
    """The manifests of a table, by batch: ``key``, and the paths of its files."""
    store, folder = file_store(f"{path}/{FOLDER}")
    if store.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    found = []
    for info in store.get_file_info(pafs.FileSelector(folder)):
        name, _, kind = info.base_name.partition(".")
        if name and kind == "json":
            files = json.loads(read_whole(store, info.path))["files"]
            found.append({"key": info.base_name, "batch": int(name.partition("=")[2]), "files": files})
    return sorted(found, key=lambda entry: entry["batch"])


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All published batches of a table."""
    files = [f"{path}/{name}" for entry in published_files(path) for name in entry["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

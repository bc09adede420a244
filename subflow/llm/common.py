"""What the operators share: tables, staged results, words, and files in shared storage."""

from __future__ import annotations

import uuid
from contextlib import suppress

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.workspace import shared_folder

# The white space of the words `[^\x20\x09-\x0D]+`.
WHITE_SPACE = " \t\n\x0b\x0c\r"

# A table of this many bytes, as measured, goes to every executor; larger ones are shuffled.
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Staged tables of one run, in the folder that all executors share.

    Reading a staged table costs a lost executor nothing but the read. ``drop`` removes
    one as soon as a later table holds what is needed from it; what the result still
    reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{label}"

    def stage(self, df: DataFrame, label: str, share: float = 1.0, is_light: bool = False) -> DataFrame:
        """Write ``df`` and read it back; with ``share``, in so many of the shuffle's files.

        A table that is small beside the texts needs fewer files than these, in proportion.
        Its rows are dealt anew for that, so what makes them has all its tasks; where that
        ``is_light``, it is done in as many tasks as files, which saves a shuffle.
        """
        if share < 1:
            files = max(2, round(int(self.spark.conf.get("spark.sql.shuffle.partitions")) * share))
            df = df.coalesce(files) if is_light else df.repartition(files)
        path = self.path(label)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *staged: DataFrame) -> None:
        for df in staged:
            self.drop_path(df._scratch_path)

    def drop_path(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder in shared storage, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def publish(fs: pafs.FileSystem, made: str, final: str) -> None:
    """Give a finished file its name. A repeated task replaces the file with an equal one."""
    with suppress(FileNotFoundError):
        fs.move(made, final)


def without(docs: DataFrame, gone: DataFrame, same: Column, scratch: Scratch) -> DataFrame:
    """``docs`` without those that a line of ``gone`` is the same as.

    ``gone`` is written and measured; up to ``BROADCAST_BYTES`` it goes to every task and
    the documents stay where they are, beyond that both sides are shuffled.
    """
    gone = scratch.stage(gone, "gone")
    width = 8 * len(gone.columns)
    if gone.count() * width <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, same, "left_anti")


def word_count(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text holds; null holds none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.size(F.filter(F.split(spaced, " "), lambda word: word != "")).cast("bigint")


def texts_of(series) -> list[str]:
    """The texts of an Arrow or pandas column, null as empty."""
    return [x if isinstance(x, str) else "" for x in series.tolist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number through the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

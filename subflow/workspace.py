"""Where staged tables and stream checkpoints go."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own; a cluster gets an
    error, since its machines do not share a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="subflow-")
    return _local_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows starts from files, so a lost executor costs a re-read and not a
    recomputation, and Catalyst knows the size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._staged_path)


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.delete(target, True)


def visible_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder that Spark's readers see, by name; none if there is no folder."""
    system, target = _at(spark, folder)
    if not system.exists(target):
        return []
    found = (status.getPath() for status in system.listStatus(target))
    return sorted(f"{folder}/{p.getName()}" for p in found if p.getName()[0] not in "_.")


def move_to(spark: SparkSession, path: str, to: str) -> None:
    """Give a file another place and name."""
    system, source = _at(spark, path)
    _, target = _at(spark, to)
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"{to} could not be written")


def rename_new(spark: SparkSession, path: str, to: str) -> bool:
    """Give a file a name that nothing has yet; if something has it, remove the file."""
    jvm = spark._jvm
    _, source = _at(spark, path)
    _, target = _at(spark, to)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    kept = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, kept)
        return True
    except Exception as error:
        if not exists(spark, to):
            raise OSError(f"{to} could not be written") from error
        remove(spark, path)
        return False

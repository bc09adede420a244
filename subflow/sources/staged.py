"""Stage tables: typed rows that one step writes and others read, whole or as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_stage(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_stage(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream into a stage table; its log makes every batch appear once and whole."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

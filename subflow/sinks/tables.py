"""Tables in a folder, written per batch so that a repeated batch replaces itself."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subflow.operators.lists import explode_lists
from subflow.schemas import STORED_COLUMNS, STORED_ROW

# The two stored tables.
SHORT_TABLE = "subscription"
LONG_TABLE = "longSubscription"


def write_batch(df: DataFrame, path: str, batch_id: int, by: str = "batch_id") -> None:
    """Write ``df`` as one partition of a table, in place of any earlier try."""
    df.write.mode("overwrite").parquet(f"{path}/{by}={batch_id}")


def read_batch(
    spark: SparkSession, path: str, schema: T.StructType, batch_id: int, by: str = "batch_id"
) -> DataFrame:
    """One partition of a table, without a listing of the others."""
    return spark.read.schema(schema).parquet(f"{path}/{by}={batch_id}")


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, by: str) -> None:
    """Make the folder of a partitioned table, so that a stream can be started on it."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(by).parquet(path)


def new_batch_id() -> int:
    """A number no other batch has."""
    return uuid.uuid4().int >> 65


def store_items(items: DataFrame, path: str, batch_id: int) -> None:
    """Rows with their bucket flag to the two tables, in one pass and without a shuffle.

    A batch replaces what an earlier try under its id wrote, and nothing else.
    """
    table = F.when(F.col("isMoreYear"), F.lit(LONG_TABLE)).otherwise(F.lit(SHORT_TABLE))
    (
        items.select(
            *STORED_COLUMNS,
            table.alias("table"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table", "batch_id")
        .parquet(path)
    )


def store_lists(lists: DataFrame, path: str, batch_id: int) -> None:
    """Bucketed lists to the two tables; usable as a ``foreachBatch`` function's body."""
    store_items(explode_lists(lists), path, batch_id)


def read_stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = T.StructType(
        [
            *STORED_ROW.fields,
            T.StructField("table", T.StringType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )
    stored = spark.read.schema(schema).parquet(path)
    return stored.filter(F.col("table") == table).select(*STORED_COLUMNS)

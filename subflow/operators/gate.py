"""The gate: rows leave with their file, marked by whether the file is complete."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.operators.spread import attach_per_key


def held_counts(rows: DataFrame) -> DataFrame:
    """Good rows in hand, per file."""
    return rows.groupBy("file_name").agg(F.count("*").alias("held"))


def release_status(held: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per file with rows: how many, and whether that is the reconciled number.

    A file without a status, or with another number of rows than its status says,
    is one the stream lets go after the idle time: ``is_complete`` is false.
    """
    complete = F.coalesce(F.col("held") == F.col("countGoodRecords"), F.lit(False))
    return held.join(statuses, "file_name", "left").select(
        "file_name", "held", complete.alias("is_complete")
    )


def gate(rows: DataFrame, statuses: DataFrame, **spread) -> DataFrame:
    """All rows, each with its file's ``is_complete``."""
    per_file = release_status(held_counts(rows), statuses)
    return attach_per_key(rows, per_file, on="file_name", weight="held", **spread)

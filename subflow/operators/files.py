"""File level: verdict on the name, header check, end marker, file status."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.functions import names
from subflow.schemas import END_MARK


def check_files(files: DataFrame, as_of=None) -> DataFrame:
    """Add ``errors``: null for a good name, else its one text."""
    return files.withColumn("errors", names.name_errors(F.col("file_name"), as_of))


def passed_files(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("errors").isNull()).drop("errors")


def failed_files(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("errors").isNotNull()).select("file_name", "errors")


def of_good_files(rows: DataFrame, as_of=None) -> DataFrame:
    """The rows whose file name passes; a filter on the name alone, no join."""
    return rows.filter(names.is_good_name(F.col("file_name"), as_of))


def of_bad_files(rows: DataFrame, as_of=None) -> DataFrame:
    """The other rows; on a file source this opens only the files that fail."""
    return rows.filter(~names.is_good_name(F.col("file_name"), as_of))


def mask_fields(files: DataFrame) -> DataFrame:
    """Add what the name says: product, client, user, date."""
    return files.select("*", *names.mask_fields(F.col("file_name")))


def is_end_row():
    return F.col("id_text").eqNullSafe(F.lit(END_MARK))


def data_records(records: DataFrame) -> DataFrame:
    """All records but the closing ones."""
    return records.filter(~is_end_row())


def end_records(records: DataFrame) -> DataFrame:
    return records.filter(is_end_row())


def file_success(assembled: DataFrame) -> DataFrame:
    """(file, rows assembled) for every file that has its end marker.

    Takes the output of :func:`subflow.operators.rows.assemble`. Counts are
    combined before the shuffle, so a file of any size sends one row per task.
    """
    return (
        assembled.groupBy("file_name")
        .agg(
            F.count_if(F.col("reason").isNull() & ~F.col("is_end")).alias("countRecord"),
            F.bool_or("is_end").alias("ended"),
        )
        .filter("ended")
        .select("file_name", "countRecord")
    )

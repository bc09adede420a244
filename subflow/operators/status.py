"""Per-file reconciliation of declared, checked and good rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def success_status(rows: DataFrame) -> DataFrame:
    """Good rows as statuses."""
    return rows.select(
        "*",
        F.lit(None).cast(T.ArrayType(T.StringType())).alias("errors"),
        F.lit(True).alias("is_valid"),
    )


def union_statuses(fails: DataFrame, successes: DataFrame) -> DataFrame:
    """Failed and good row statuses as one table; ``is_valid`` tells them apart.

    The output of :func:`subflow.operators.rows.check_rows` is the same table already
    and takes one scan where the union of its two sides takes two.
    """
    return fails.withColumn("is_valid", F.lit(False)).unionByName(successes)


def status_counts(statuses: DataFrame) -> DataFrame:
    """Rows checked and rows good, per file; combined before the shuffle."""
    return statuses.groupBy("file_name").agg(
        F.count("*").alias("seen"), F.count_if("is_valid").alias("good")
    )


def reconcile(file_success: DataFrame, counts: DataFrame) -> DataFrame:
    """(file, good rows) for each file with as many statuses as it declared rows.

    A file that declared no rows and has no statuses comes out with 0.
    """
    seen = F.coalesce("seen", F.lit(0))
    return (
        file_success.join(counts, "file_name", "left")
        .filter(seen == F.col("countRecord"))
        .select("file_name", F.coalesce("good", F.lit(0)).alias("countGoodRecords"))
    )

"""What each arrival of rows adds to its files, as counts.

The stateful steps never see rows. A batch of checked rows is written to a table
under its arrival number, and one line of counts per file and arrival follows it;
Spark combines the counts before the shuffle. So a file with a third of all rows
costs the state one line per arrival, like any other.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.schemas import PROGRESS


def file_progress(file_success: DataFrame, arrival: int) -> DataFrame:
    """Declared row counts."""
    return file_success.select(
        "file_name",
        F.lit(arrival).cast("bigint").alias("arrival"),
        "countRecord",
        F.lit(0).cast("bigint").alias("seen"),
        F.lit(0).cast("bigint").alias("good"),
    ).to(PROGRESS)


def row_progress(counts: DataFrame, arrival: int) -> DataFrame:
    """Counts of checked and good rows."""
    return counts.select(
        "file_name",
        F.lit(arrival).cast("bigint").alias("arrival"),
        F.lit(None).cast("bigint").alias("countRecord"),
        "seen",
        "good",
    ).to(PROGRESS)

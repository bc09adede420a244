"""Business rules on one subscription row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from subflow.functions.names import as_date, file_date

# Fixed values.
LONG_DURATION_DAYS = 365
ROW_FAULT = "Expected valid SubscriptionData but got: "


def is_good_row(as_of=None, start_by_file_date: bool = False) -> Column:
    """Started before ``as_of``, ends ``duration`` days later, nothing negative or NaN.

    ``start_by_file_date`` adds the rule that no row starts after its file's date.
    """
    start, end = F.col("startDate"), F.col("endDate")
    duration, price = F.col("duration"), F.col("price")
    good = (
        (start < as_date(as_of))
        & (start < end)
        & (F.datediff(end, start) == duration)
        & (duration >= 0)
        & ~F.isnan(price)  # NaN is the largest double in Spark, so NaN >= 0
        & (price >= 0)
    )
    if start_by_file_date:
        good = good & (start <= file_date(F.col("file_name")))
    return F.coalesce(good, F.lit(False))


def row_error() -> Column:
    row = F.to_json(F.struct("id", "startDate", "endDate", "duration", "price"))
    return F.concat(F.lit(ROW_FAULT), row, F.lit(" from "), F.col("file_name"))


def is_more_year(duration: Column | None = None) -> Column:
    """Over 365 days; 366 counts as over a year, leap year or not."""
    return (F.col("duration") if duration is None else duration) > LONG_DURATION_DAYS

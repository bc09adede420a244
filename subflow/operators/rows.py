"""Row level: text cells to typed rows, business rules, pass/fail split."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.functions import rules
from subflow.functions.cells import decimal_number, iso_date, once, whole_number
from subflow.operators.files import is_end_row
from subflow.schemas import DURATION, END, ID, PACKET_COLUMNS, PRICE, START

# Why a row was not assembled; the first that applies.
BAD_HEADER = "headers are not the five columns"


def assemble(records: DataFrame) -> DataFrame:
    """Typed columns, ``is_end`` and ``reason`` (null for an assembled or end row).

    Nothing is dropped here: the split into rows, rejects and end markers is a
    filter on the two flags, and all consumers share one scan.
    """
    typed = records.select(
        "*",
        once(
            is_end=is_end_row(),
            id=whole_number(F.col("id_text")),
            startDate=iso_date(F.col("start_text")),
            endDate=iso_date(F.col("end_text")),
            duration=whole_number(F.col("duration_text")),
            price=decimal_number(F.col("price_text")),
        ),
    )
    reason = (
        F.when(F.col("is_end"), None)
        .when(~F.col("headers_ok"), F.lit(BAD_HEADER))
        .when(F.col("id").isNull(), F.lit(f"{ID} is not a number"))
        .when(F.col("startDate").isNull(), F.lit(f"{START} is not a date"))
        .when(F.col("endDate").isNull(), F.lit(f"{END} is not a date"))
        .when(F.col("duration").isNull(), F.lit(f"{DURATION} is not a number"))
        .when(F.col("price").isNull(), F.lit(f"{PRICE} is not a number"))
    )
    return typed.withColumn("reason", reason)


def packets(assembled: DataFrame) -> DataFrame:
    """The assembled rows."""
    return assembled.filter(~F.col("is_end") & F.col("reason").isNull()).select(*PACKET_COLUMNS)


def row_rejects(assembled: DataFrame) -> DataFrame:
    """Rows that could not be assembled, with their cells as text."""
    return assembled.filter(F.col("reason").isNotNull()).select(
        "file_name", "id_text", "start_text", "end_text", "duration_text", "price_text", "reason"
    )


def check_rows(rows: DataFrame, as_of=None, start_by_file_date: bool = False) -> DataFrame:
    """Add ``is_valid``, and ``errors``: one text for any broken rule, null for a good row.

    Filters go by the flag, so that a text is built only where someone reads it.
    """
    return rows.withColumn("is_valid", rules.is_good_row(as_of, start_by_file_date)).withColumn(
        "errors", F.when(~F.col("is_valid"), F.array(rules.row_error()))
    )


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.filter("is_valid").select(*PACKET_COLUMNS)


def failed_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("is_valid")).select(*PACKET_COLUMNS, "errors")


def good_rows_with_arrival(checked: DataFrame) -> DataFrame:
    """Good rows of a staged table of checked records, with the arrival they came in and where they stood."""
    return checked.filter("is_valid").select(*PACKET_COLUMNS, "arrival", "record_at")

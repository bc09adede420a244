"""Checks on a delivered file's name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The dot before "csv" stands for any character.
NAME_PATTERN = r"^\w{3}_\d{4}_\d{5}_\d{8}.csv$"
DATE_PLACE = (16, 8)  # in a valid name
BAD_NAME = "filename doesn't correct"
BAD_DATE = "date later than now"

# Texts of our own, for files the two fixed texts do not cover.
UNREADABLE_DATE = "date in the filename can't be read"
NO_ID_COLUMN = "header has no # column"


def as_date(as_of) -> Column:
    """The day that counts as today: a date, an ISO text, a column, or None for the clock."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def has_valid_name(name: Column) -> Column:
    return name.rlike(NAME_PATTERN)


def _date_of(digits: Column) -> Column:
    """ddMMyyyy; days 29 to 31 beyond the end of a month mean its last day."""
    first = F.try_to_date(F.concat(F.lit("01"), F.substring(digits, 3, 6)), "ddMMyyyy")
    day = F.substring(digits, 1, 2).try_cast("int")
    clamped = F.when(
        day.between(29, 31), F.date_add(first, F.least(day, F.dayofmonth(F.last_day(first))) - 1)
    )
    # Nearly all dates exist as they stand, so the clamped form is rarely computed.
    date = F.coalesce(F.try_to_date(digits, "ddMMyyyy"), clamped)
    return F.when(~digits.endswith("0000"), date)


def file_date(name: Column) -> Column:
    """The date in a valid name: 31022021 is 2021-02-28; month 13, day 0 or 32 and year 0 give null."""
    return _date_of(F.substring(name, *DATE_PLACE))


def is_good_name(name: Column, as_of=None) -> Column:
    """Valid name and a date not after ``as_of``; never null."""
    date_ok = F.coalesce(file_date(name) <= as_date(as_of), F.lit(False))
    return has_valid_name(name) & date_ok


def _error(name: Column, text: str) -> Column:
    return F.array(F.concat(F.lit("File "), name, F.lit(f" is not valid: {text}")))


def name_errors(name: Column, as_of=None) -> Column:
    """Null for a good file; else an array with the one text for its first fault."""
    return (
        F.when(is_good_name(name, as_of), None)
        .when(~has_valid_name(name), _error(name, BAD_NAME))
        .when(file_date(name).isNull(), _error(name, UNREADABLE_DATE))
        .otherwise(_error(name, BAD_DATE))
    )


def no_id_column_error(name: Column) -> Column:
    return _error(name, NO_ID_COLUMN)


def mask_fields(name: Column) -> list[Column]:
    """Product, client and user codes and the date of a well-formed name; else nulls."""
    part = lambda i: F.when(
        has_valid_name(name), F.regexp_extract(name, r"^(\w{3})_(\d{4})_(\d{5})_", i)
    )
    return [
        part(1).alias("product"),
        part(2).alias("client"),
        part(3).alias("user"),
        F.when(has_valid_name(name), file_date(name)).alias("file_date"),
    ]

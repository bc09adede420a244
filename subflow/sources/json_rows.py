"""Subscription rows from JSON lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.functions.cells import iso_date, once
from subflow.schemas import SUBSCRIPTION

# Numbers are read as they stand, so that a quoted one can be told from a bare one and a
# fraction from a whole number, all in one parse.
_FIELDS = "id variant, startDate string, endDate string, duration variant, price variant"


def _bare(field: str, kind: str) -> Column:
    """A number that isn't quoted, as ``kind``; anything else is a fault."""
    value = F.col(f"json.{field}")
    is_number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(is_number, F.try_variant_get(value, "$", kind))


def _whole(field: str) -> Column:
    """A whole number; the fraction of one like 1.5 is cut off."""
    exact = _bare(field, "decimal(38,18)").try_cast("bigint")
    return F.coalesce(exact, _bare(field, "double").try_cast("bigint"))


def parse_json_rows(lines: DataFrame) -> DataFrame:
    """``value`` plus the five fields; ``ok`` only where all five are right.

    Dates are ISO texts and numbers are bare: a quoted number is a fault.
    """
    json = lines.select("value", once(json=F.from_json("value", _FIELDS)))
    price = _bare("price", "double")
    parsed = json.select(
        "value",
        once(
            id=_whole("id"),
            startDate=iso_date(F.col("json.startDate")),
            endDate=iso_date(F.col("json.endDate")),
            duration=_whole("duration"),
            price=F.when(~F.isnan(price) & (F.abs(price) != float("inf")), price),
        ),
    )
    complete = F.lit(True)
    for name in SUBSCRIPTION.fieldNames():
        complete = complete & F.col(name).isNotNull()
    return parsed.withColumn("ok", complete)


def json_rows(lines: DataFrame) -> DataFrame:
    return parse_json_rows(lines).filter("ok").select(*SUBSCRIPTION.fieldNames())


def json_rejects(lines: DataFrame) -> DataFrame:
    return parse_json_rows(lines).filter(~F.col("ok")).select("value")


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark.read.text(path))


def stream_json_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark.readStream.text(path))


def as_json_lines(rows: DataFrame) -> DataFrame:
    """Rows back to JSON lines, dates as ISO texts."""
    return rows.select(F.to_json(F.struct(*SUBSCRIPTION.fieldNames())).alias("value"))

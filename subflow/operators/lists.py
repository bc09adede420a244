"""Rows to bucketed lists per file, and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.functions.cells import epoch_day
from subflow.functions.rules import is_more_year
from subflow.operators.ranks import ranked
from subflow.operators.spread import attach_per_key
from subflow.schemas import ITEM_COLUMNS, PACKET_COLUMNS, STORED_COLUMNS
from subflow.workspace import staged

LIST_ROWS = 100_000


def stored_items(rows: DataFrame) -> DataFrame:
    """Rows as the stored tables hold them (dates as epoch days), with their bucket."""
    return rows.select(
        *[c for c in rows.columns if c not in PACKET_COLUMNS or c == "file_name"],
        "id",
        epoch_day(F.col("startDate")).alias("startDate"),
        epoch_day(F.col("endDate")).alias("endDate"),
        "duration",
        "price",
        is_more_year().alias("isMoreYear"),
    )


def bucket_lists(rows: DataFrame, list_rows: int = LIST_ROWS, **spread) -> DataFrame:
    """(file, isMoreYear, part, parts, list), the list in order of its items; none empty.

    A file's bucket comes in ``parts`` lists of about ``list_rows`` rows, numbered from 0,
    that together hold every row once; so a large file is never in one task, and a
    reader sees whether a list is the whole bucket. Which list a row is in follows from
    the row alone. Copies of a row are counted first and dealt out to the parts in turn.
    """
    bucket = F.struct("file_name", "isMoreYear")
    counted = (
        stored_items(rows)
        .withColumn("bucket", bucket)
        .groupBy("bucket", *ITEM_COLUMNS)
        .agg(F.count("*").alias("copies"))
    )
    counted = staged(counted, "items")
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("n"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / list_rows).cast("int"))
    placed = attach_per_key(counted, sizes, on="bucket", weight="n", **spread)
    # Of n copies over p parts, those from the row's own part on get one more.
    first = F.pmod(F.xxhash64(*ITEM_COLUMNS), F.col("parts")).cast("int")
    turns = F.least(F.col("copies"), F.col("parts").cast("bigint")).cast("int")
    dealt = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    here = F.floor((F.col("copies") - F.col("turn") - 1) / F.col("parts")) + 1
    copies = F.array_repeat(F.struct(*ITEM_COLUMNS), here.cast("int"))
    return (
        dealt.withColumn("part", F.pmod(first + F.col("turn"), F.col("parts")))
        .withColumn("copies", copies)
        .groupBy("bucket", "part", "parts")
        .agg(F.sort_array(F.flatten(F.collect_list("copies"))).alias("list"))
        .select("bucket.*", "part", "parts", "list")
    )


def ordered_lists(rows: DataFrame, list_rows: int = LIST_ROWS, **spread) -> DataFrame:
    """As ``bucket_lists``, with the rows in the order in which they stood in their file.

    For rows with ``record_at`` and, from several arrivals, ``arrival``. Part 0 has a
    bucket's first ``list_rows`` rows, part 1 the next, and so on.
    """
    order = [c for c in ("arrival", "record_at") if c in rows.columns]
    placed = ranked(stored_items(rows), ["file_name", "isMoreYear"], [*order, *ITEM_COLUMNS])
    item = F.struct("rank", F.struct(*ITEM_COLUMNS).alias("item"))
    bucket = F.struct("file_name", "isMoreYear").alias("bucket")
    part = F.floor((F.col("rank") - 1) / list_rows).cast("int")
    made = placed.groupBy(bucket, part.alias("part")).agg(F.sort_array(F.collect_list(item)).alias("list"))
    made = staged(made.select("bucket", "part", F.col("list.item").alias("list")), "ordered-lists")
    sizes = made.groupBy("bucket").agg((F.max("part") + 1).alias("parts"), F.count("*").alias("n"))
    whole = attach_per_key(made, sizes, on="bucket", weight="n", **spread)
    return whole.select("bucket.*", "part", "parts", "list")


def explode_lists(lists: DataFrame) -> DataFrame:
    """Lists back to rows, with the bucket flag."""
    return lists.select("isMoreYear", F.explode("list").alias("item")).select(
        "isMoreYear", "item.*"
    )


def short_rows(items: DataFrame) -> DataFrame:
    """What the table for up to a year gets; the id is not stored."""
    return items.filter(~F.col("isMoreYear")).select(*STORED_COLUMNS)


def long_rows(items: DataFrame) -> DataFrame:
    """What the table for over a year gets."""
    return items.filter("isMoreYear").select(*STORED_COLUMNS)

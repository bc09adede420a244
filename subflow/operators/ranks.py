"""Ranks of rows within their key, by prefix sums, so that no key is one task's work."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subflow.workspace import staged

# Lines of counts up to this many go to every executor.
BROADCAST_LINES = 200_000


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``rank``, from 1, among those of their key ``by``, in the order ``order``.

    Rows are ranged by key and order, so that a large key is many tasks, and each task's
    file is in order. A row's rank is its number in its file, moved by the counts of the
    files before it; these are a line per file and key. Rows that are equal in all of
    ``order`` are ranked in the order in which they are read.
    """
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    place = [*by, *order, "_read"]
    in_order = staged(rows.repartitionByRange(*place).sortWithinPartitions(*place).drop("_read"), "in-order")
    located = in_order.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    counts = staged(
        located.groupBy("_file", *by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")), "rank-counts"
    )
    before = Window.partitionBy(*by).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    moved = counts.select("_file", *by, (earlier - F.col("_first") + 1).alias("_move"))
    if counts.count() <= BROADCAST_LINES:
        moved = F.broadcast(moved)
    keys = [f"_key{i}" for i in range(len(by))]
    moved = moved.withColumnsRenamed({**dict(zip(by, keys)), "_file": "_in"})
    same = located["_file"] == moved["_in"]
    for name, key in zip(by, keys):
        same = same & located[name].eqNullSafe(moved[key])
    return located.join(moved, same).withColumn("rank", F.col("_row") + F.col("_move")).select(*in_order.columns, "rank")

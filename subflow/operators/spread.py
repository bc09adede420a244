"""Attach one small row per key to many rows, without a hot key slowing the job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subflow.workspace import staged

# A per-key table up to this many bytes, as measured, goes to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
# A key is hot when it holds more than 1/HOT_SHARE of all rows; so fewer than
# HOT_SHARE keys can be hot, and their list is always small.
HOT_SHARE = 1000
# Rows of a key with that share go to this many tasks; more for a larger share.
TASKS_PER_SHARE = 4


def spread_over(n: Column, *columns: str) -> Column:
    """A number below ``n`` that a repeated task gives every row again."""
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), n).cast("int")


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    on: str,
    weight: str,
    how: str = "inner",
    is_staged: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``rows`` with ``per_key`` on ``on``; ``weight`` is a count that isn't taken over.

    The per-key table is staged (unless it ``is_staged`` already) and measured. Small, it
    is broadcast and the rows are not shuffled at all. Otherwise the rows are counted by
    key, combined before the shuffle, and then shuffled by key, those of a hot key by key
    and salt, with the key's row repeated once per salt; this holds for keys that
    ``per_key`` lacks as well. The salt comes from the row's values and its task's
    number: a repeated task sends every row the same way again, and copies of one row
    part by the tasks that hold them.
    """
    if not is_staged:
        per_key = staged(per_key, "per-key")
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) + 32), F.lit(0))
    measured = per_key.agg(size.alias("bytes")).first()["bytes"]
    value_columns = [c for c in per_key.columns if c not in (on, weight)]
    if measured <= broadcast_bytes:
        return rows.join(F.broadcast(per_key.select(on, *value_columns)), on, how)

    counts = staged(rows.groupBy(on).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    share = F.ceil(F.col("_n") * hot_share / F.lit(total))
    # A null key has no partner, but its rows are split like others.
    hot = counts.filter(F.col("_n") * hot_share > total).select(
        F.col(on).alias("_hot"), (share * TASKS_PER_SHARE).cast("int").alias("_salts")
    )
    hot = F.broadcast(hot)  # fewer than hot_share lines
    salts = F.coalesce("_salts", F.lit(1))
    salted_rows = (
        rows.join(hot, rows[on].eqNullSafe(F.col("_hot")), "left")
        .withColumn("_salt", spread_over(salts, *rows.columns))
        .drop("_salts", "_hot")
    )
    salted_keys = (
        per_key.select(on, *value_columns)
        .join(hot, F.col(on) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts", "_hot")
    )
    return salted_rows.join(salted_keys, [on, "_salt"], how).drop("_salt")

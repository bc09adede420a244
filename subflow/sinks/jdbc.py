"""The two stored tables in a database, by Spark's JDBC writer."""

from pyspark.sql import DataFrame

from subflow.operators.lists import explode_lists, long_rows, short_rows
from subflow.sinks.tables import LONG_TABLE, SHORT_TABLE

# Inserts per round trip, and connections at a time, unless the caller says otherwise.
DEFAULTS = {"batchsize": "10000", "numPartitions": "16"}


def store_items_jdbc(
    items: DataFrame,
    url: str,
    properties: dict[str, str],
    short_table: str = SHORT_TABLE,
    long_table: str = LONG_TABLE,
) -> None:
    """Append rows to the table of their bucket; the caller brings url and credentials.

    ``items`` is read twice, so hand in a written table rather than a long plan.
    There is no key: a repeated call appends its rows again.
    """
    options = {**DEFAULTS, **properties}
    short_rows(items).write.jdbc(url, short_table, mode="append", properties=options)
    long_rows(items).write.jdbc(url, long_table, mode="append", properties=options)


def store_lists_jdbc(lists: DataFrame, url: str, properties: dict[str, str], **tables) -> None:
    store_items_jdbc(explode_lists(lists), url, properties, **tables)

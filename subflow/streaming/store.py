"""Micro-batch sinks."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from subflow.sinks.jdbc import store_lists_jdbc
from subflow.sinks.tables import store_lists
from subflow.workspace import discard, staged


def store_stream(lists: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Bucketed lists of a stream to the two tables; a repeated batch replaces itself."""
    return (
        lists.writeStream.foreachBatch(lambda batch, batch_id: store_lists(batch, path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def store_batch_jdbc(
    lists: DataFrame, batch_id: int, url: str, properties: dict[str, str], **tables
) -> None:
    """One micro-batch into a database; written out first, as both tables read it.

    The tables have no key: a micro-batch that is repeated after a failure appends its
    rows again.
    """
    written = staged(lists, f"jdbc-{batch_id}")
    store_lists_jdbc(written, url, properties, **tables)
    discard(written)


def store_stream_jdbc(
    lists: DataFrame, url: str, properties: dict[str, str], checkpoint: str, tables: dict[str, str] | None = None, **trigger
) -> StreamingQuery:
    """Bucketed lists of a stream to the two tables of a database; the caller brings access."""
    return (
        lists.writeStream.foreachBatch(
            lambda batch, batch_id: store_batch_jdbc(batch, batch_id, url, properties, **(tables or {}))
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

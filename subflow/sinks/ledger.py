"""Rows into a database so that a repeated batch adds nothing: staged, then moved in one transaction.

Tasks insert into a staging table, each try under a token of its own. When all are done,
one transaction writes the batch's id into a ledger, moves the rows of the tries that
count to their tables by ``INSERT ... SELECT``, and clears the batch's staged rows; the
rows never pass through the driver. If the ledger has the id, the batch had been stored,
and only its staged rows are cleared. A batch that fails clears what its tasks staged; what
a lost executor left goes with the next try.

It works on any DB-API connection. ``connect`` names a function, as ``module:function``,
that every worker can import; the caller's properties are its arguments. Tables:

    staging (batch_id bigint, token text, is_long boolean, startDate bigint, endDate bigint,
             duration bigint, price double)
    ledger (batch_id bigint primary key)
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from subflow.operators.lists import explode_lists
from subflow.schemas import STORED_COLUMNS
from subflow.sinks.tables import LONG_TABLE, SHORT_TABLE

ROWS_AT_ONCE = 10_000


@dataclass
class Tables:
    staging: str = "subscriptionStaging"
    ledger: str = "subscriptionLedger"
    short: str = SHORT_TABLE
    long: str = LONG_TABLE
    mark: str = "?"


@dataclass
class _Staged(WriterCommitMessage):
    token: str


class LedgerWriter(DataSourceWriter):
    def __init__(self, batch_id: int, connect: str, properties: dict[str, str], tables: Tables) -> None:
        self.batch_id, self.connect, self.properties, self.tables = batch_id, connect, properties, tables

    def _connection(self):
        module, function = self.connect.split(":")
        return getattr(import_module(module), function)(**self.properties)

    def write(self, iterator: Iterator) -> _Staged:
        """One task's rows into the staging table."""
        t, token = self.tables, uuid.uuid4().hex
        columns = ["batch_id", "token", "is_long", *STORED_COLUMNS]
        insert = f"INSERT INTO {t.staging} ({', '.join(columns)}) VALUES ({', '.join([t.mark] * len(columns))})"
        connection = self._connection()
        try:
            cursor = connection.cursor()
            rows = ((self.batch_id, token, r["isMoreYear"], *(r[c] for c in STORED_COLUMNS)) for r in iterator)
            while some := list(islice(rows, ROWS_AT_ONCE)):
                cursor.executemany(insert, some)
            connection.commit()
        finally:
            connection.close()
        return _Staged(token)

    def commit(self, messages: list) -> None:
        t, tokens = self.tables, [m.token for m in messages if m is not None]
        connection = self._connection()
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT count(*) FROM {t.ledger} WHERE batch_id = {t.mark}", (self.batch_id,))
            if not cursor.fetchone()[0]:
                # A second run at the same time fails here, by the ledger's key, with all it did.
                cursor.execute(f"INSERT INTO {t.ledger} (batch_id) VALUES ({t.mark})", (self.batch_id,))
                columns = ", ".join(STORED_COLUMNS)
                for token in tokens:
                    for table, flag in ((t.short, False), (t.long, True)):
                        cursor.execute(
                            f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {t.staging} "
                            f"WHERE batch_id = {t.mark} AND token = {t.mark} AND is_long = {t.mark}",
                            (self.batch_id, token, flag),
                        )
            cursor.execute(f"DELETE FROM {t.staging} WHERE batch_id = {t.mark}", (self.batch_id,))
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def abort(self, messages: list) -> None:
        t = self.tables
        connection = self._connection()
        try:
            cursor = connection.cursor()
            for message in messages:
                if message is not None:
                    cursor.execute(
                        f"DELETE FROM {t.staging} WHERE batch_id = {t.mark} AND token = {t.mark}",
                        (self.batch_id, message.token),
                    )
            connection.commit()
        finally:
            connection.close()


class LedgerSink(DataSource):
    """``df.write.format("subscription_ledger")``; options ``batch_id``, ``connect``, ``properties``, ``tables`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "subscription_ledger"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        o = self.options
        tables = Tables(**json.loads(o.get("tables", "{}")))
        return LedgerWriter(int(o["batch_id"]), o["connect"], json.loads(o.get("properties", "{}")), tables)


def store_items_once(
    items: DataFrame, batch_id: int, connect: str, properties: dict[str, str] | None = None, tables: dict[str, str] | None = None
) -> None:
    """Rows with their bucket flag to the two tables of a database; a batch that was stored adds nothing."""
    spark: SparkSession = items.sparkSession
    spark.dataSource.register(LedgerSink)
    writer = items.select(F.col("isMoreYear"), *STORED_COLUMNS).write.format("subscription_ledger").mode("append")
    options = {"batch_id": str(batch_id), "connect": connect, "properties": json.dumps(properties or {}), "tables": json.dumps(tables or {})}
    writer.options(**options).save()


def store_lists_once(lists: DataFrame, batch_id: int, connect: str, **options) -> None:
    """Bucketed lists; usable as a ``foreachBatch`` function's body."""
    store_items_once(explode_lists(lists), batch_id, connect, **options)

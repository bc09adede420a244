"""One run over a folder of delivered files, or over records from anywhere."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.operators import files, gate, lists, rows, status
from subflow.schemas import CHECKED, PACKET_COLUMNS
from subflow.sinks.tables import new_batch_id, store_items
from subflow.sources import delimited
from subflow.workspace import staged


def checked_records(
    records: DataFrame, as_of=None, start_by_file_date: bool = False
) -> DataFrame:
    """Every record with all that is known of it: typed cells, reason, errors, flags.

    One table from which each result is a filter or a count.
    """
    judged = rows.check_rows(rows.assemble(records), as_of, start_by_file_date)
    is_row = F.col("reason").isNull() & ~F.col("is_end")
    flags = {name: F.when(is_row, F.col(name)) for name in ("is_valid", "errors")}
    return judged.withColumns(flags).to(CHECKED)


@dataclass
class Outcome:
    """What became of files and rows."""

    checked: DataFrame
    file_rejects: DataFrame

    @property
    def row_rejects(self) -> DataFrame:
        return rows.row_rejects(self.checked)

    @property
    def assembled(self) -> DataFrame:
        return self.checked.filter("reason is null and not is_end")

    @property
    def row_failures(self) -> DataFrame:
        return rows.failed_rows(self.assembled)

    @property
    def good_rows(self) -> DataFrame:
        return rows.good_rows(self.assembled)

    @property
    def placed_rows(self) -> DataFrame:
        """Good rows with the byte of their file that they began at."""
        return self.checked.filter("is_valid").select(*PACKET_COLUMNS, "record_at")

    @property
    def file_success(self) -> DataFrame:
        return files.file_success(self.checked)

    @property
    def statuses(self) -> DataFrame:
        counts = status.status_counts(self.assembled)
        return status.reconcile(self.file_success, counts)

    @property
    def released(self) -> DataFrame:
        """Good rows with ``is_complete``."""
        return gate.gate(self.good_rows, self.statuses)

    def store(self, path: str, batch_id: int | None = None) -> None:
        """All good rows to the two tables: complete files or not, each row is released.

        Rows are added to those that are there. A run that may be repeated gives its own
        ``batch_id``; then it replaces what it wrote before.
        """
        batch_id = new_batch_id() if batch_id is None else batch_id
        store_items(lists.stored_items(self.good_rows), path, batch_id)


def ingest_folder(
    spark: SparkSession,
    path: str,
    as_of=None,
    nested: bool = False,
    start_by_file_date: bool = False,
) -> Outcome:
    """Check, read and judge all files of a folder; the text is scanned and parsed once.

    Every file gets a verdict, whatever its name, and an empty one too.
    """
    listed = staged(delimited.read_files(spark, path, nested), "files")
    good = files.of_good_files(listed, as_of)
    headers = staged(delimited.file_headers(good), "headers")
    records = delimited.header_records(good, headers, is_staged=True)
    names = files.check_files(listed.select("file_name").distinct(), as_of)
    return Outcome(
        checked=staged(checked_records(records, as_of, start_by_file_date), "checked"),
        file_rejects=files.failed_files(names).unionByName(delimited.without_id_column(headers)),
    )

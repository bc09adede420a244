"""The same run on a stream of files, as streaming queries over stage tables.

* names: names of new files -> files rejected by their name, which are never opened
* arrivals: new files -> checked rows, rejects and counts, per micro-batch
* statuses: counts -> reconciled files
* releases: reconciled files and counts -> released rows -> the two stored tables
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from subflow.operators import files, lists, rows, status
from subflow.plans.batch import checked_records
from subflow.schemas import (
    CHECKED,
    FILE_FAIL,
    PACKET_COLUMNS,
    PROGRESS,
    RECONCILED,
    RELEASE,
    RELEASE_CUT,
    RELEASED,
)
from subflow.sinks.manifest import is_published, publish_batch
from subflow.sinks.tables import read_batch, store_items, write_batch
from subflow.sources import delimited, staged
from subflow.sources.discovery import Found
from subflow.sources.published import stream_published
from subflow.streaming import gate as stream_gate
from subflow.streaming import reconcile
from subflow.streaming.progress import file_progress, row_progress
from subflow.workspace import discard, exists, remove
from subflow.workspace import staged as stage_once


class Layout:
    """Folders of a continuous run, below one root in storage that all executors share."""

    def __init__(self, root: str) -> None:
        self.root = root
        self.checked = f"{root}/checked"
        self.progress = f"{root}/progress"
        self.statuses = f"{root}/statuses"
        self.releases = f"{root}/releases"
        self.released = f"{root}/released"
        self.stored = f"{root}/stored"
        self.name_rejects = f"{root}/name_rejects"
        self.first_rejects = f"{root}/first_rejects"
        self.file_rejects = f"{root}/file_rejects"
        self.row_rejects = f"{root}/row_rejects"
        self.row_failures = f"{root}/row_failures"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/checkpoints/{query}"

    def log(self, query: str) -> str:
        """Where a stream of files writes down what it has found."""
        return f"{self.root}/found/{query}"


def names_query(names: DataFrame, layout: Layout, as_of=None, **trigger) -> StreamingQuery:
    """Files that fail by their name, from the listing alone."""
    rejects = files.failed_files(files.check_files(names, as_of))
    return staged.append_stream(
        rejects,
        layout.name_rejects,
        layout.checkpoint("names"),
        **(trigger or {"processingTime": "1 second"}),
    )


def read_file_rejects(spark: SparkSession, layout: Layout) -> DataFrame:
    """All rejected files: by name, and those without a # column."""
    read = lambda path: spark.read.schema(FILE_FAIL).parquet(path).select(*FILE_FAIL.fieldNames())
    rejects = read(layout.name_rejects).unionByName(read(layout.file_rejects))
    return rejects.unionByName(read(layout.first_rejects)) if exists(spark, layout.first_rejects) else rejects


def stage_arrival(arrived: DataFrame, arrival: int, layout: Layout, as_of=None) -> None:
    """One micro-batch of files, or of lines: rows first, their counts last.

    Counts appear only once the rows they count are all there. A repeated
    micro-batch replaces its own partition of every table; if its counts are there,
    it was done. The counts appear whole and under a name that stays, so the streams
    that read them see them once.
    """
    spark = arrived.sparkSession
    if is_published(spark, layout.progress, arrival, by="arrival"):
        return
    good = files.of_good_files(arrived, as_of)
    headers = stage_once(delimited.file_headers(good), "headers")
    records = delimited.header_records(good, headers, is_staged=True)
    write_batch(checked_records(records, as_of), layout.checked, arrival, by="arrival")

    checked = read_batch(spark, layout.checked, CHECKED, arrival, by="arrival")
    assembled = checked.filter("reason is null and not is_end")
    rejects = delimited.without_id_column(headers)
    write_batch(rejects, layout.file_rejects, arrival, by="arrival")
    write_batch(rows.row_rejects(checked), layout.row_rejects, arrival, by="arrival")
    write_batch(rows.failed_rows(assembled), layout.row_failures, arrival, by="arrival")

    counts = status.status_counts(assembled)
    progress = file_progress(files.file_success(checked), arrival).unionByName(
        row_progress(counts, arrival)
    )
    publish_batch(progress, layout.progress, arrival, by="arrival")
    discard(headers)


def arrivals_query(
    arrived: DataFrame, layout: Layout, as_of=None, first_arrival: int = 0, **trigger
) -> StreamingQuery:
    """Rows of the files with a good name, from a stream of files or of lines; the others are not opened."""
    return (
        files.of_good_files(arrived, as_of)
        .writeStream.foreachBatch(
            lambda batch, batch_id: stage_arrival(batch, first_arrival + batch_id, layout, as_of)
        )
        .option("checkpointLocation", layout.checkpoint("arrivals"))
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def start_with_batch(
    spark: SparkSession, path: str, layout: Layout, as_of=None, nested: bool = False
) -> dict[str, int]:
    """Take all files that are there now in one batch job, as arrival 0, before the streams start.

    The streams of files of this layout (with ``layout.log("names")`` and ``"arrivals"``)
    then find the others only; give the result, which says that their arrivals begin at 1,
    to ``arrivals_query``. It may be repeated until it has been done, before the streams are
    started; then it does nothing.
    """
    if not is_published(spark, layout.progress, 0, by="arrival"):
        listed = stage_once(delimited.read_files(spark, path, nested), "files")
        for query in ("names", "arrivals"):
            Found(layout.log(query)).take(r["file_path"] for r in listed.select("file_path").toLocalIterator())
        checked = files.check_files(listed.select("file_name").distinct(), as_of)
        write_batch(files.failed_files(checked), layout.first_rejects, 0)
        stage_arrival(listed, 0, layout, as_of)
    return {"first_arrival": 1}


_WITH_ARRIVAL = T.StructType([*CHECKED.fields, T.StructField("arrival", T.LongType())])


def read_checked(spark: SparkSession, layout: Layout) -> DataFrame:
    """All records so far, by arrival."""
    return spark.read.schema(_WITH_ARRIVAL).parquet(layout.checked)


def read_arrivals(spark: SparkSession, layout: Layout, arrivals: list[int]) -> DataFrame:
    """Records of some arrivals; the folders of the others are not even listed."""
    if not arrivals:
        return spark.createDataFrame([], _WITH_ARRIVAL)
    paths = [f"{layout.checked}/arrival={a}" for a in arrivals]
    reader = spark.read.schema(_WITH_ARRIVAL).option("basePath", layout.checked)
    return reader.parquet(*paths)


def remove_arrivals(spark: SparkSession, layout: Layout, arrivals: list[int]) -> None:
    """Remove the records of arrivals whose rows have all been released."""
    for arrival in arrivals:
        remove(spark, f"{layout.checked}/arrival={arrival}")


def progress_stream(spark: SparkSession, layout: Layout, query: str, max_batches: int | None = None) -> DataFrame:
    """Counts of the arrivals, in their order, as a query of that name sees them."""
    return stream_published(spark, layout.progress, PROGRESS, layout.log(f"{query}-progress"), max_batches)


def statuses_query(
    spark: SparkSession, layout: Layout, idle_ms: int = reconcile.IDLE_MS, **trigger
) -> StreamingQuery:
    idle = None if trigger.get("availableNow") else idle_ms
    statuses = reconcile.reconcile_stream(progress_stream(spark, layout, "statuses"), idle)
    return staged.append_stream(
        statuses,
        layout.statuses,
        layout.checkpoint("statuses"),
        **(trigger or {"processingTime": "1 second"}),
    )


def release_batch(releases: DataFrame, batch_id: int, layout: Layout) -> None:
    """Write the releases first, so that the stateful step runs once; then their rows.

    A batch without releases leaves nothing behind.
    """
    spark = releases.sparkSession
    write_batch(releases, layout.releases, batch_id)
    schema = RELEASE_CUT if "upto" in releases.columns else RELEASE
    written = read_batch(spark, layout.releases, schema, batch_id)
    if written.isEmpty():
        remove(spark, f"{layout.releases}/batch_id={batch_id}")
        return
    released = stream_gate.released_rows(
        written, lambda some: rows.good_rows_with_arrival(read_arrivals(spark, layout, some))
    )
    write_batch(released, layout.released, batch_id)
    out = read_batch(spark, layout.released, RELEASED, batch_id)
    store_items(lists.stored_items(out.select(*PACKET_COLUMNS)), layout.stored, batch_id)


def releases_query(
    spark: SparkSession, layout: Layout, idle_ms: int = stream_gate.IDLE_MS, by_row: bool = False, **trigger
) -> StreamingQuery:
    """Released rows; ``by_row``, a file's rows leave at the very one that completes it."""
    found = staged.stream_stage(spark, layout.statuses, RECONCILED)
    statuses = found.filter("is_reconciled").drop("is_reconciled")
    releases = stream_gate.gate_stream(statuses, progress_stream(spark, layout, "releases"), idle_ms, by_row)
    return (
        releases.writeStream.foreachBatch(
            lambda batch, batch_id: release_batch(batch, batch_id, layout)
        )
        .option("checkpointLocation", layout.checkpoint("releases"))
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )

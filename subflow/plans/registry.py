"""The registered queries: every operator, run over the given order tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.operators import files, gate, lists, rows, status
from subflow.plans import batch, continuous
from subflow.schemas import (
    BUCKET_LIST,
    FILE_FAIL,
    PACKET_COLUMNS,
    RECONCILED,
    ROW_REJECT,
    ROW_STATUS,
)
from subflow.sinks.manifest import publish_batch
from subflow.sinks.tables import (
    LONG_TABLE,
    SHORT_TABLE,
    read_batch,
    read_stored,
    store_items,
    write_batch,
)
from subflow.sources import delimited, json_rows, orders
from subflow.sources.staged import append_stream, read_stage, stream_stage, write_stage
from subflow.streaming.progress import file_progress, row_progress
from subflow.streaming.reconcile import reconcile_stream
from subflow.streaming.session import run_until_idle
from subflow.streaming.store import store_stream
from subflow.workspace import new_path, staged

AS_OF = orders.AS_OF
IDLE_MS = 1_000
# Rows of a delivery's part file, about; what is written stays in proportion to the input.
ROWS_PER_PART = 250_000


def _out(df: DataFrame) -> DataFrame:
    """Dates as ISO texts and the one error as a text, for comparison by value."""
    for field in df.schema.fields:
        if field.dataType.typeName() == "date":
            df = df.withColumn(field.name, F.col(field.name).cast("string"))
    if "errors" in df.columns:
        df = df.withColumn("error", F.get("errors", F.lit(0))).drop("errors")
    return df


# The steps on tables. Each starts from the order tables and builds on the one before.


def _checked_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.check_files(orders.files(spark, sf).select("file_name"), AS_OF)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return files.of_good_files(orders.records(spark, sf), AS_OF)


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    return rows.assemble(_records(spark, sf))


def _checked(spark: SparkSession, sf: str, strict: bool = False) -> DataFrame:
    return rows.check_rows(rows.packets(_assembled(spark, sf)), AS_OF, strict)


def _good(spark: SparkSession, sf: str) -> DataFrame:
    return rows.good_rows(_checked(spark, sf))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_counts(_checked(spark, sf))


def _sent(checked: DataFrame) -> DataFrame:
    """Statuses as they arrive, apart from the rows they are of: some are lost, some doubled.

    In files whose five digits are a multiple of 5 the status of row 1 is lost; where they
    are a multiple of 7 that of row 2 comes twice.
    """
    number = F.substring("file_name", 10, 5).try_cast("int")
    times = F.when((F.col("id") == 1) & (number % 5 == 0), 0)
    times = times.when((F.col("id") == 2) & (number % 7 == 0), 2).otherwise(1)
    return checked.withColumn("_time", F.explode(F.array_repeat(F.lit(0), times))).drop("_time")


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose statuses, as they arrived, are as many as the rows they declared."""
    return status.reconcile(_file_success(spark, sf), status.status_counts(_sent(_checked(spark, sf))))


def _file_success(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_success(_assembled(spark, sf))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return lists.stored_items(_good(spark, sf))


def bucket_totals(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _items(spark, sf)
        .groupBy("isMoreYear")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("price"),
        )
    )


def file_check(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_checked_files(spark, sf))


def files_passed(spark: SparkSession, sf: str) -> DataFrame:
    return files.passed_files(_checked_files(spark, sf))


def file_rejects(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "file-rejects")
    write_batch(files.failed_files(_checked_files(spark, sf)), path, 0)
    return _out(read_batch(spark, path, FILE_FAIL, 0))


def mask_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _out(files.mask_fields(orders.files(spark, sf).select("file_name")))


def header_check(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of the written files, by whether its file's header names its cells."""
    records = delimited.read_records(spark, _deliveries(spark, sf), AS_OF, nested=True)
    return files.data_records(records).select("file_name", "id_text", "headers_ok")


def end_markers(spark: SparkSession, sf: str) -> DataFrame:
    return files.end_records(_records(spark, sf)).select("file_name")


def assemble_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _out(rows.packets(_assembled(spark, sf)))


def row_rejects(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "row-rejects")
    write_batch(rows.row_rejects(_assembled(spark, sf)), path, 0)
    return read_batch(spark, path, ROW_REJECT, 0)


def row_check(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_checked(spark, sf).drop("errors"))


def row_check_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_checked(spark, sf, strict=True).drop("errors"))


def good_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _out(_good(spark, sf))


def row_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _out(rows.failed_rows(_checked(spark, sf)))


def file_success(spark: SparkSession, sf: str) -> DataFrame:
    return _file_success(spark, sf)


def status_union(spark: SparkSession, sf: str) -> DataFrame:
    checked = staged(_checked(spark, sf), "checked")
    fails, successes = rows.failed_rows(checked), status.success_status(rows.good_rows(checked))
    return _out(status.union_statuses(fails, successes))


def stage_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "row-status")
    write_stage(_checked(spark, sf), path)
    return _out(read_stage(spark, path, ROW_STATUS))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _statuses(spark, sf)


def held_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gate.held_counts(_good(spark, sf))


def gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    checked = batch.checked_records(_records(spark, sf), AS_OF)
    checked = staged(checked.select(*PACKET_COLUMNS, "is_end", "reason", "is_valid"), "checked")
    assembled = checked.filter("reason is null and not is_end")
    counts = status.status_counts(_sent(assembled))
    statuses = status.reconcile(files.file_success(checked), counts)
    return _out(gate.gate(rows.good_rows(assembled), statuses))


def bucket_lists(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda i: F.concat_ws(
        ":", i.id, i.startDate, i.endDate, i.duration, F.format_string("%.2f", i.price)
    )
    built = lists.bucket_lists(staged(_good(spark, sf), "good"))
    return built.select(
        "file_name",
        "isMoreYear",
        "part",
        "parts",
        F.size("list").cast("bigint").alias("n"),
        F.array_join(F.transform("list", item), ",").alias("items"),
    )


def list_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lists.explode_lists(lists.bucket_lists(staged(_good(spark, sf), "good")))


def _stored(spark: SparkSession, sf: str, table: str) -> DataFrame:
    path = new_path(spark, "stored")
    store_items(_items(spark, sf), path, 0)
    return read_stored(spark, path, table)


def store_rows_short(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, SHORT_TABLE)


def store_rows_long(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, LONG_TABLE)


# The file sources: the tables are written out as files, which are then read.


def _deliveries(spark: SparkSession, sf: str, parts: int | None = None) -> str:
    path = new_path(spark, "deliveries")
    parts = parts or 2 + orders.row_count(spark, sf) // ROWS_PER_PART
    orders.write_deliveries(spark, sf, path, parts)
    return path


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    records = delimited.read_records(spark, _deliveries(spark, sf), AS_OF, nested=True)
    checked = rows.check_rows(rows.packets(rows.assemble(records)), AS_OF)
    return _out(checked.drop("errors"))


def csv_row_rejects(spark: SparkSession, sf: str) -> DataFrame:
    done = batch.ingest_folder(spark, _deliveries(spark, sf), AS_OF, nested=True)
    return done.row_rejects.groupBy("file_name", "reason").agg(F.count("*").alias("n"))


def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery with its verdict, declared rows and good rows."""
    path = _deliveries(spark, sf)
    done = batch.ingest_folder(spark, path, AS_OF, nested=True)
    return _out(
        delimited.list_files(spark, path, nested=True)
        .join(done.file_rejects, "file_name", "left")
        .join(done.file_success, "file_name", "left")
        .join(done.statuses, "file_name", "left")
    )


def csv_stored(spark: SparkSession, sf: str) -> DataFrame:
    done = batch.ingest_folder(spark, _deliveries(spark, sf), AS_OF, nested=True)
    path = new_path(spark, "stored")
    done.store(path)
    short, long = (
        read_stored(spark, path, table).withColumn("table", F.lit(table))
        for table in (SHORT_TABLE, LONG_TABLE)
    )
    return short.unionByName(long)


def _flat_files(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "flat")
    orders.write_flat_files(spark, sf, path)
    return path


def flat_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of a folder, empty and hidden ones too, with its verdict and its counts."""
    path = _flat_files(spark, sf)
    done = batch.ingest_folder(spark, path, AS_OF)
    rejected = done.row_rejects.groupBy("file_name").agg(F.count("*").alias("rejected"))
    return _out(
        delimited.list_files(spark, path)
        .join(done.file_rejects, "file_name", "left")
        .join(done.file_success, "file_name", "left")
        .join(done.statuses, "file_name", "left")
        .join(rejected, "file_name", "left")
    )


def ordered_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's buckets as lists in the order of the file, which many tasks may have read."""
    done = batch.ingest_folder(spark, _flat_files(spark, sf), AS_OF)
    built = lists.ordered_lists(done.placed_rows)
    item = lambda i: F.concat_ws(":", i.id, i.startDate, i.endDate, i.duration, F.format_string("%.2f", i.price))
    return built.select(
        "file_name",
        "isMoreYear",
        "part",
        "parts",
        F.size("list").cast("bigint").alias("n"),
        F.array_join(F.transform("list", item), ",").alias("items"),
    )


def json_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "json-rows")
    orders.write_json_rows(spark, sf, path)
    return _out(json_rows.read_json_rows(spark, path))


def json_rejects(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "json-rows")
    orders.write_json_rows(spark, sf, path)
    rejects = json_rows.json_rejects(spark.read.text(path))
    return rejects.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), "value")


# The streams: stage tables made from the order tables, read as streams.


def _stage_rows(spark: SparkSession, sf: str, root: str) -> continuous.Layout:
    """Checked records as a table with two arrivals: even and odd row numbers."""
    layout = continuous.Layout(root)
    records = batch.checked_records(_records(spark, sf), AS_OF)
    arrival = F.when(F.col("is_end"), 1).otherwise(F.coalesce("id", F.lit(0)) % 2)
    (
        records.withColumn("arrival", arrival.cast("bigint"))
        .write.partitionBy("arrival")
        .parquet(layout.checked)
    )
    return layout


def _arrived(spark: SparkSession, layout: continuous.Layout, arrival: int | None = None) -> DataFrame:
    """Assembled rows of an arrival, or of all."""
    rows_ = continuous.read_checked(spark, layout).filter("reason is null and not is_end")
    return rows_ if arrival is None else rows_.filter(F.col("arrival") == arrival)


def _stage_progress(spark: SparkSession, layout: continuous.Layout, arrivals: list[int]) -> None:
    for arrival in arrivals:
        counts = status.status_counts(_arrived(spark, layout, arrival))
        publish_batch(row_progress(counts, arrival), layout.progress, arrival, by="arrival")


def _stage_statuses(spark: SparkSession, layout: continuous.Layout) -> None:
    success = files.file_success(continuous.read_checked(spark, layout))
    counts = status.status_counts(_sent(_arrived(spark, layout)))
    statuses = status.reconcile(success, counts).withColumn("is_reconciled", F.lit(True))
    write_stage(statuses, layout.statuses)


def _release(spark: SparkSession, layout: continuous.Layout, by_row: bool = False) -> None:
    run_until_idle(continuous.releases_query(spark, layout, IDLE_MS, by_row))


def _released(spark: SparkSession, layout: continuous.Layout) -> DataFrame:
    released = spark.read.parquet(layout.released)
    return _out(released.select(*PACKET_COLUMNS, "is_complete"))


def stream_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of even rows, then the declared numbers, then odd rows: a micro-batch each."""
    layout = _stage_rows(spark, sf, new_path(spark, "stream-reconcile"))
    success = files.file_success(continuous.read_checked(spark, layout))
    counts = [status.status_counts(_sent(_arrived(spark, layout, a))) for a in (0, 1)]
    lines = [row_progress(counts[0], 0), file_progress(success, 1), row_progress(counts[1], 2)]
    for arrival, progress in enumerate(lines):
        publish_batch(progress, layout.progress, arrival, by="arrival")
    progress = continuous.progress_stream(spark, layout, "statuses", max_batches=1)
    stream = reconcile_stream(progress, idle_ms=None)
    query = append_stream(stream, layout.statuses, layout.checkpoint("statuses"), processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    found = read_stage(spark, layout.statuses, RECONCILED)
    return found.filter("is_reconciled").drop("is_reconciled")


def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    layout = _stage_rows(spark, sf, new_path(spark, "stream-gate"))
    _stage_progress(spark, layout, [0, 1])
    _stage_statuses(spark, layout)
    _release(spark, layout)
    return _released(spark, layout)


def stream_gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """As ``stream_gate``, to the row: as many rows leave complete as the status says, the others by the timer."""
    layout = _stage_rows(spark, sf, new_path(spark, "stream-gate-rows"))
    _stage_statuses(spark, layout)
    _stage_progress(spark, layout, [0, 1])
    _release(spark, layout, by_row=True)
    return _released(spark, layout)


def stream_idle_release(spark: SparkSession, sf: str) -> DataFrame:
    """No file is ever reconciled, so all rows leave by the timer."""
    layout = _stage_rows(spark, sf, new_path(spark, "stream-idle"))
    _stage_progress(spark, layout, [0, 1])
    write_stage(spark.createDataFrame([], RECONCILED), layout.statuses)
    _release(spark, layout)
    return _released(spark, layout)


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Odd rows come after the idle time has let the even ones go."""
    layout = _stage_rows(spark, sf, new_path(spark, "stream-late"))
    _stage_progress(spark, layout, [0])
    _stage_statuses(spark, layout)
    _release(spark, layout)
    _stage_progress(spark, layout, [1])
    _release(spark, layout)
    return _released(spark, layout)


def stream_store(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "stream-store")
    write_stage(lists.bucket_lists(staged(_good(spark, sf), "good")).select(*BUCKET_LIST.fieldNames()), f"{root}/lists")
    stream = stream_stage(spark, f"{root}/lists", BUCKET_LIST)
    store_stream(stream, f"{root}/stored", f"{root}/checkpoint").awaitTermination()
    short, long = (
        read_stored(spark, f"{root}/stored", table).withColumn("table", F.lit(table))
        for table in (SHORT_TABLE, LONG_TABLE)
    )
    return short.unionByName(long)


def stream_json(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "stream-json")
    orders.write_json_rows(spark, sf, f"{root}/lines")
    query = (
        json_rows.stream_json_rows(spark, f"{root}/lines")
        .writeStream.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _out(spark.read.parquet(f"{root}/rows"))


def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    """From delivered files to released rows, all by streams."""
    path = _deliveries(spark, sf, parts=1)
    layout = continuous.Layout(new_path(spark, "stream-files"))
    # Fewer files at a time than there are, so that files come in several arrivals.
    lines = delimited.stream_lines(spark, path, nested=True, max_files=40)
    names = delimited.stream_names(spark, path, nested=True)
    now = {"availableNow": True}
    continuous.names_query(names, layout, AS_OF, **now).awaitTermination()
    continuous.arrivals_query(lines, layout, AS_OF, **now).awaitTermination()
    continuous.statuses_query(spark, layout, **now).awaitTermination()
    _release(spark, layout)
    return _released(spark, layout)


def stream_flat_files(spark: SparkSession, sf: str) -> DataFrame:
    """As ``stream_files``, from the listing of a flat folder; and what was rejected by name or as empty."""
    path = _flat_files(spark, sf)
    layout = continuous.Layout(new_path(spark, "stream-flat"))
    # Fewer files at a time than there are.
    names = delimited.stream_files(spark, path, layout.log("names"), max_files=1000).select("file_name")
    found = delimited.stream_files(spark, path, layout.log("arrivals"), max_files=1000)
    run_until_idle(continuous.names_query(names, layout, AS_OF))
    run_until_idle(continuous.arrivals_query(found, layout, AS_OF))
    continuous.statuses_query(spark, layout, availableNow=True).awaitTermination()
    _release(spark, layout)
    rejects = _out(continuous.read_file_rejects(spark, layout))
    released = _released(spark, layout).withColumn("error", F.lit(None).cast("string"))
    return released.unionByName(rejects, allowMissingColumns=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bucket_totals": bucket_totals,
    "file_check": file_check,
    "files_passed": files_passed,
    "file_rejects": file_rejects,
    "mask_fields": mask_fields,
    "header_check": header_check,
    "end_markers": end_markers,
    "assemble_rows": assemble_rows,
    "row_rejects": row_rejects,
    "row_check": row_check,
    "row_check_strict": row_check_strict,
    "good_rows": good_rows,
    "row_failures": row_failures,
    "file_success": file_success,
    "status_union": status_union,
    "stage_table": stage_table,
    "status_counts": status_counts,
    "reconcile": reconcile,
    "held_counts": held_counts,
    "gate": gate_rows,
    "bucket_lists": bucket_lists,
    "list_rows": list_rows,
    "store_rows_short": store_rows_short,
    "store_rows_long": store_rows_long,
    "csv_files": csv_files,
    "csv_rows": csv_rows,
    "csv_row_rejects": csv_row_rejects,
    "csv_stored": csv_stored,
    "flat_files": flat_files,
    "ordered_lists": ordered_lists,
    "json_rows": json_subscriptions,
    "json_rejects": json_rejects,
    "stream_reconcile": stream_reconcile,
    "stream_gate": stream_gate,
    "stream_gate_rows": stream_gate_rows,
    "stream_idle_release": stream_idle_release,
    "stream_late_rows": stream_late_rows,
    "stream_store": stream_store,
    "stream_json": stream_json,
    "stream_files": stream_files,
    "stream_flat_files": stream_flat_files,
}

"""Streams: either side first, timers, late rows, repeated batches, stream = batch."""

from pyspark.sql import functions as F

from subflow.operators.rows import good_rows_with_arrival
from subflow.plans import continuous
from subflow.plans.batch import ingest_folder
from subflow.schemas import COLLECTOR_STATUS, PROGRESS, RECONCILED, RELEASE
from subflow.sinks.tables import write_batch
from subflow.sources import delimited
from subflow.sources.staged import append_stream, stream_stage
from subflow.streaming.gate import gate_stream, released_rows
from subflow.streaming.reconcile import reconcile_stream
from subflow.streaming.session import run_until_idle
from subflow.workspace import exists, remove

HEAD = "#,StartDate,EndDate,Duration,Price"
TODAY = "2026-12-01"


def progress(spark, path, arrival, *lines):
    """Lines are (file, declared or None, seen, good)."""
    rows = [(name, arrival, declared, seen, good) for name, declared, seen, good in lines]
    write_batch(spark.createDataFrame(rows, PROGRESS), path, arrival, by="arrival")


def test_reconcile_in_either_order(spark, tmp_path):
    table, out = str(tmp_path / "progress"), str(tmp_path / "out")

    def run():
        stream = reconcile_stream(stream_stage(spark, table, PROGRESS), idle_ms=None)
        append_stream(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.file_name: r.countGoodRecords for r in spark.read.schema(RECONCILED).parquet(out).collect()}

    progress(spark, table, 0, ("declared first", 3, 0, 0), ("rows first", None, 2, 1), ("empty", 0, 0, 0),
             ("too many", None, 3, 3), ("never declared", None, 1, 1))
    assert run() == {"empty": 0}
    progress(spark, table, 1, ("declared first", None, 2, 2), ("rows first", None, 1, 1), ("too many", 2, 0, 0))
    assert run() == {"empty": 0}
    progress(spark, table, 2, ("declared first", None, 1, 0), ("rows first", 3, 0, 0))
    assert run() == {"empty": 0, "declared first": 2, "rows first": 2}


def test_reconcile_counts_an_arrival_once_and_meets_within_one(spark, tmp_path):
    table, out = str(tmp_path / "progress"), str(tmp_path / "out")

    def run():
        stream = reconcile_stream(stream_stage(spark, table, PROGRESS), idle_ms=None)
        append_stream(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
        return {r.file_name: r.countGoodRecords for r in spark.read.schema(RECONCILED).parquet(out).collect()}

    progress(spark, table, 0, ("twice", 4, 0, 0), ("twice", None, 2, 2), ("over", 3, 0, 0), ("over", None, 2, 1))
    assert run() == {}
    # The same arrival again, under other file names.
    progress(spark, table, 0, ("twice", 4, 0, 0), ("twice", None, 2, 2))
    assert run() == {}
    progress(spark, table, 1, ("twice", None, 2, 1), ("over", None, 5, 4))
    assert run() == {"twice": 3, "over": 5}


def test_files_that_never_meet_are_given_up(spark, tmp_path):
    table, out = str(tmp_path / "progress"), str(tmp_path / "out")
    progress(spark, table, 0, ("short", 9, 0, 0), ("short", None, 2, 1), ("undeclared", None, 1, 1), ("fine", 0, 0, 0))
    stream = reconcile_stream(stream_stage(spark, table, PROGRESS), idle_ms=500)
    query = append_stream(stream, out, str(tmp_path / "checkpoint"), processingTime="0 seconds")
    run_until_idle(query, 60)
    got = {(r.file_name, r.countGoodRecords, r.is_reconciled) for r in spark.read.schema(RECONCILED).parquet(out).collect()}
    assert got == {("short", 1, False), ("undeclared", 1, False), ("fine", 0, True)}


def test_gate_in_either_order_by_timer_and_for_late_rows(spark, tmp_path):
    table, statuses, out = (str(tmp_path / n) for n in ("progress", "statuses", "out"))

    def status(*rows):
        spark.createDataFrame(rows, COLLECTOR_STATUS).write.mode("append").parquet(statuses)

    def run():
        releases = gate_stream(
            stream_stage(spark, statuses, COLLECTOR_STATUS), stream_stage(spark, table, PROGRESS), 500
        )
        query = (
            releases.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .start()
        )
        run_until_idle(query, 60)
        return {
            (r.file_name, tuple(r.arrivals), r.held, r.is_complete)
            for r in spark.read.parquet(out).collect()
        }

    status(("status first", 2), ("no good rows", 0), ("one short", 2), ("nothing came", 5))
    progress(spark, table, 0, ("status first", None, 3, 2), ("one short", None, 1, 1),
             ("no status", None, 4, 3), ("only bad rows", None, 2, 0))
    first = {
        ("status first", (0,), 2, True),
        ("one short", (0,), 1, False),
        ("no status", (0,), 3, False),
    }
    assert run() == first
    # The state is gone: late rows start anew and wait for their own timer.
    progress(spark, table, 1, ("one short", None, 1, 1), ("no status", None, 1, 1), ("new", None, 1, 1))
    progress(spark, table, 2, ("new", None, 1, 1))
    status(("new", 2))
    late = {("one short", (1,), 1, False), ("no status", (1,), 1, False), ("new", (1, 2), 2, True)}
    assert run() == first | late


def deliver(folder, product, good, bad, end=True):
    rows = [f"{i},2021-01-01,2021-01-02,1,{i}" for i in range(good)]
    rows += [f"{i},2021-01-01,2021-01-01,1,1" for i in range(bad)]
    text = "\n".join([HEAD, *rows, *(["end"] if end else [])])
    (folder / f"{product}_1234_12345_01012021.csv").write_text(text)


def test_stream_of_files_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    deliver(folder, "AAA", 3, 2)
    deliver(folder, "AAB", 0, 2)
    deliver(folder, "AAC", 2, 0, end=False)
    (folder / "plain.csv").write_text("x")
    layout = continuous.Layout(str(tmp_path / "run"))
    now = {"availableNow": True}

    def run():
        lines = delimited.stream_lines(spark, str(folder), max_files=2)
        names = delimited.stream_names(spark, str(folder))
        continuous.names_query(names, layout, TODAY, **now).awaitTermination()
        continuous.arrivals_query(lines, layout, TODAY, **now).awaitTermination()
        continuous.statuses_query(spark, layout, **now).awaitTermination()
        run_until_idle(continuous.releases_query(spark, layout, 500), 90)

    run()
    deliver(folder, "AAD", 4, 1)  # a file that comes after the stream was started
    run()

    batch = ingest_folder(spark, str(folder), TODAY)
    released = spark.read.parquet(layout.released).drop("batch_id")
    assert sorted(map(str, released.collect())) == sorted(map(str, batch.released.collect()))
    assert released.count() == 9
    stored = spark.read.parquet(layout.stored)
    assert stored.count() == 9
    rejects = continuous.read_file_rejects(spark, layout)
    assert sorted(map(str, rejects.collect())) == sorted(map(str, batch.file_rejects.collect()))
    assert rejects.count() == 1
    for table, expected in (
        (layout.row_failures, batch.row_failures),
        (layout.row_rejects, batch.row_rejects),
    ):
        got = spark.read.schema(expected.schema).parquet(table).drop("arrival")
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_a_repeated_arrival_counts_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    deliver(folder, "AAA", 3, 2)
    layout = continuous.Layout(str(tmp_path / "run"))
    lines = delimited.read_lines(spark, str(folder))
    for _ in range(2):
        continuous.stage_arrival(lines, 0, layout, TODAY)
    # Nor does one that failed between its rows and its counts.
    remove(spark, f"{layout.checked}/arrival=0/_SUCCESS")
    continuous.stage_arrival(lines, 0, layout, TODAY)
    counts = spark.read.parquet(layout.progress).agg(F.sum("seen"), F.sum("countRecord")).first()
    assert tuple(counts) == (5, 5)
    assert continuous.read_checked(spark, layout).count() == 6


def test_a_release_reads_its_own_arrivals_only(spark, tmp_path):
    """One late row of a large file brings back one arrival, and not the rows around it."""
    folder = tmp_path / "in"
    layout = continuous.Layout(str(tmp_path / "run"))
    for arrival in range(4):
        folder.mkdir(exist_ok=True)
        deliver(folder, f"AA{arrival}", 5, 0)
        lines = delimited.read_lines(spark, str(folder)).filter(F.col("file_name").startswith(f"AA{arrival}"))
        continuous.stage_arrival(lines, arrival, layout, TODAY)
    name = "AA3_1234_12345_01012021.csv"
    other = "AA0_1234_12345_01012021.csv"
    releases = spark.createDataFrame([(name, [3], 5, True), (other, [0, 3], 5, False)], RELEASE)
    asked = []

    def read(arrivals):
        asked.append(arrivals)
        return good_rows_with_arrival(continuous.read_arrivals(spark, layout, arrivals))

    for limit in ({}, {"broadcast_bytes": -1}):
        out = released_rows(releases, read, **limit)
        got = {(r.file_name, r.is_complete): r["count"] for r in out.groupBy("file_name", "is_complete").count().collect()}
        assert got == {(name, True): 5, (other, False): 5}
    assert asked == [[0, 3]] * 2
    paths = {f.split("/arrival=")[1][0] for f in continuous.read_arrivals(spark, layout, [0, 3]).inputFiles()}
    assert paths == {"0", "3"}


def test_a_batch_without_releases_leaves_nothing(spark, tmp_path):
    layout = continuous.Layout(str(tmp_path / "run"))
    continuous.release_batch(spark.createDataFrame([], RELEASE), 0, layout)
    assert not exists(spark, f"{layout.releases}/batch_id=0")

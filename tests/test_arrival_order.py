"""Ranks, lists in the order of a file, releases within an arrival, a batch before a stream."""

import random

import pytest

from subflow.operators.lists import bucket_lists, ordered_lists
from subflow.operators.ranks import ranked
from subflow.plans import continuous
from subflow.plans.batch import ingest_folder
from subflow.schemas import COLLECTOR_STATUS, PACKET, PROGRESS, RELEASE_CUT
from subflow.sinks.manifest import publish_batch
from subflow.sources import delimited
from subflow.sources.staged import stream_stage
from subflow.streaming.gate import HoldFile, gate_stream, released_rows
from subflow.streaming.reconcile import ReconcileFile
from subflow.streaming.session import run_until_idle

TODAY = "2026-12-01"
HEAD = "#,StartDate,EndDate,Duration,Price"


def test_ranks_of_a_large_key_and_of_copies(spark):
    pick = random.Random(2)
    rows = [(k, pick.randrange(50)) for k in ["hot"] * 3000 + ["a", "b", None] * 40]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(6)
    got = ranked(df, ["k"], ["v"]).collect()
    for key in ("hot", "a", "b", None):
        values = [r.v for r in sorted((r for r in got if r.k == key), key=lambda r: r["rank"])]
        assert values == sorted(v for k, v in rows if k == key)
        assert sorted(r["rank"] for r in got if r.k == key) == list(range(1, len(values) + 1))
    assert ranked(df.limit(0), ["k"], ["v"]).collect() == []


def test_lists_equal_the_files_order(spark, tmp_path):
    pick = random.Random(3)
    rows = [(pick.randrange(1000), pick.choice([1, 400])) for _ in range(500)]
    lines = [f"{i},2021-01-01,{'2021-01-02' if d == 1 else '2022-02-05'},{d},{i}" for i, d in rows]
    (tmp_path / "AAA_1234_12345_01012021.csv").write_text("\n".join([HEAD, *lines, "end"]))
    files = delimited.read_files(spark, str(tmp_path))
    headers = delimited.staged(delimited.file_headers(files), "headers")
    records = delimited.header_records(files, headers, range_bytes=100, is_staged=True)
    from subflow.plans.batch import Outcome, checked_records

    placed = Outcome(checked_records(records, TODAY), files).placed_rows
    built = {(r.isMoreYear, r.part): r for r in ordered_lists(placed, list_rows=64).collect()}
    for is_long in (False, True):
        want = [i for i, d in rows if (d > 365) == is_long]
        parts = -(-len(want) // 64)
        assert {r.parts for k, r in built.items() if k[0] == is_long} == {parts}
        got = [item.id for n in range(parts) for item in built[is_long, n].list]
        assert got == want
    assert {tuple(sorted(r.list)) for r in built.values()} != {tuple(sorted(r.list)) for r in bucket_lists(placed, 64).collect()}


def test_a_release_ends_within_an_arrival(spark, tmp_path):
    """Declared 3, arrivals of 2 and 5: the first 3 leave complete, 4 later."""
    progress, statuses, out = (str(tmp_path / n) for n in ("progress", "statuses", "out"))
    spark.createDataFrame([("f", 3), ("g", 4)], COLLECTOR_STATUS).write.parquet(statuses)
    for arrival, lines in enumerate([[("f", 2), ("g", 9)], [("f", 5)]]):
        rows = [(name, arrival, None, n, n) for name, n in lines]
        publish_batch(spark.createDataFrame(rows, PROGRESS), progress, arrival, by="arrival")
    layout = continuous.Layout(str(tmp_path))
    stream = gate_stream(
        stream_stage(spark, statuses, COLLECTOR_STATUS), continuous.progress_stream(spark, layout, "t"), 500, by_row=True
    )
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
    run_until_idle(query.start(), 60)
    releases = spark.read.schema(RELEASE_CUT).parquet(out)
    assert {tuple(map(str, r)) for r in releases.collect()} == {
        ("f", "[0, 1]", "3", "True", "0", "1"),
        ("f", "[1]", "4", "False", "1", "None"),
        ("g", "[0]", "4", "True", "0", "4"),
        ("g", "[0]", "5", "False", "4", "None"),
    }
    from datetime import date

    sizes = {("f", 0): 2, ("f", 1): 5, ("g", 0): 9}
    rows = [
        (name, 100 - i, date(2021, 1, 1), date(2021, 1, 2), 1, 1.0, arrival, i)
        for (name, arrival), n in sizes.items()
        for i in range(n)
    ]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PACKET) + ", arrival bigint, record_at bigint"
    table = spark.createDataFrame(rows, schema).repartition(3)
    for limit in ({}, {"broadcast_bytes": -1}):
        done = released_rows(releases, lambda some: table.filter(table["arrival"].isin(some)), **limit).collect()
        complete = {(r.file_name, r.id) for r in done if r.is_complete}
        assert len(done) == 16 and len({(r.file_name, r.id) for r in done}) == 14  # f has the ids 100 and 99 twice
        assert complete == {("f", 100), ("f", 99), ("g", 100), ("g", 99), ("g", 98), ("g", 97)}
        assert sum(r.is_complete for r in done) == 7


class Handle:
    """What a processor sees of its state; counts the values it writes."""

    def __init__(self):
        self.value, self.items, self.written, self.read = None, [], 0, 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        outer = self

        class Items:
            def get(self):
                outer.read += len(outer.items)
                return iter(outer.items)

            def appendList(self, new):
                outer.written += len(new)
                outer.items += new

            def clear(self):
                outer.items = []

        return Items()

    def get(self):
        return self.value

    def update(self, value):
        self.written += sum(len(v) if isinstance(v, list) else 1 for v in value)
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, _):
        pass

    deleteTimer = registerTimer

    def getCurrentProcessingTimeInMs(self):
        return 0


@pytest.mark.parametrize("make", [lambda: HoldFile(1000), lambda: ReconcileFile(1000)])
def test_a_line_costs_the_same_at_ten_thousand_arrivals(make):
    from pyspark.sql import Row

    processor, handle = make(), Handle()
    processor.init(handle)
    costs = []
    for arrival in range(10_000):
        before = handle.written + handle.read
        line = Row(file_name="f", arrival=arrival, expected=None, held=1, countRecord=None, seen=1, good=1)
        assert list(processor.handleInputRows(("f",), iter([line, line]), handle)) == []
        costs.append(handle.written + handle.read - before)
    assert max(costs) <= costs[0] <= 7
    last = Row(file_name="f", arrival=10_000, expected=10_001, held=1, countRecord=10_000, seen=0, good=0)
    (out,) = processor.handleInputRows(("f",), iter([last]), handle)
    assert out.asDict().get("held", 10_001) == 10_001 and out.asDict().get("countGoodRecords", 10_000) == 10_000


def test_a_replayed_line_after_a_match_does_not_count(spark, tmp_path):
    from pyspark.sql import Row

    processor, handle = ReconcileFile(1000), Handle()
    processor.init(handle)
    declared = Row(arrival=0, countRecord=2, seen=0, good=0)
    seen = Row(arrival=0, countRecord=None, seen=2, good=1)
    assert [r.countGoodRecords for r in processor.handleInputRows(("f",), iter([seen, declared]), handle)] == [1]
    assert list(processor.handleInputRows(("f",), iter([declared, seen, seen]), handle)) == []


def test_batch_first_then_stream_equals_one_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def deliver(product, good, end=True):
        rows = [f"{i},2021-01-01,2021-01-02,1,{i}" for i in range(good)] + ["9,2021-01-01,2021-01-01,1,1"]
        (folder / f"{product}_1234_12345_01012021.csv").write_text("\n".join([HEAD, *rows, *(["end"] if end else [])]))

    deliver("AAA", 3)
    deliver("AAB", 2, end=False)
    (folder / "old.csv").write_text("x")
    layout = continuous.Layout(str(tmp_path / "run"))
    for _ in range(2):  # as after a failure
        first = continuous.start_with_batch(spark, str(folder), layout, TODAY)
    deliver("AAC", 4)
    (folder / "new.csv").write_text("")

    def found(query):
        return delimited.stream_files(spark, str(folder), layout.log(query))

    now = {"availableNow": True}
    continuous.names_query(found("names").select("file_name"), layout, TODAY, **now).awaitTermination()
    continuous.arrivals_query(found("arrivals"), layout, TODAY, **first, **now).awaitTermination()
    continuous.statuses_query(spark, layout, **now).awaitTermination()
    run_until_idle(continuous.releases_query(spark, layout, 500), 90)
    batch = ingest_folder(spark, str(folder), TODAY)
    released = spark.read.parquet(layout.released).drop("batch_id")
    assert sorted(map(str, released.collect())) == sorted(map(str, batch.released.collect()))
    assert released.count() == 9
    rejects = continuous.read_file_rejects(spark, layout)
    assert sorted(map(str, rejects.collect())) == sorted(map(str, batch.file_rejects.collect())) and rejects.count() == 2

"""Listings: all files, also as a stream that is stopped and started again."""

import json

import pytest

from subflow.plans import continuous
from subflow.plans.batch import ingest_folder
from subflow.sources import delimited
from subflow.sources.discovery import Found, file_store
from subflow.sources.listing import listed
from subflow.streaming.session import run_until_idle

TODAY = "2026-12-01"
NAMES = ["a.csv", "_b.csv", ".c.csv", "d e%20+é.csv", "_SUCCESS", "AAA_1234_12345_01012021.csv"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name in NAMES:
        (tmp_path / "in" / name).write_text("x" * len(name) if name != "a.csv" else "")
    (tmp_path / "in" / "sub").mkdir()
    return tmp_path


def test_every_name_is_listed(spark, folder):
    found = delimited.read_files(spark, str(folder / "in"))
    assert {(r.file_name, r.length) for r in found.collect()} == {(n, len(n) if n != "a.csv" else 0) for n in NAMES}
    for path in (f"file:{folder}/in", f"file://{folder}/in"):
        assert {r.file_name for r in delimited.list_files(spark, path).collect()} == set(NAMES)


def test_parts_of_nested_deliveries(folder):
    part = folder / "in" / "file_name=x%2Fy.csv"
    part.mkdir()
    for name in ("part-0", "_part", ".part-0.crc"):
        (part / name).write_text("x")
    assert [e["key"].rsplit("/", 1)[1] for e in listed(str(folder / "in"), nested=True)] == ["part-0"]


def test_no_content_is_read(spark, folder):
    for name in NAMES:
        (folder / "in" / name).chmod(0)
    assert delimited.read_files(spark, str(folder / "in")).count() == len(NAMES)


def test_a_stream_finds_each_file_once(spark, folder):
    out, log = str(folder / "out"), str(folder / "log")

    def run():
        found = delimited.stream_files(spark, str(folder / "in"), log, max_files=2)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "ck"))
        run_until_idle(query.trigger(processingTime="0 seconds").start(), 60)
        return sorted(r.file_name for r in spark.read.parquet(out).collect())

    assert run() == sorted(NAMES)
    (folder / "in" / "late.csv").write_text("")
    (folder / "in" / "a.csv").write_text("replaced")
    assert run() == sorted([*NAMES, "late.csv"])


def test_the_log_keeps_its_steps(tmp_path):
    log = Found(str(tmp_path / "log"))
    entries = [{"key": f"f{i}", "length": i} for i in range(5)]
    assert log.add(entries[:3], most=2) == 2 and log.add(entries[:3]) == 2
    again = Found(str(tmp_path / "log"))  # after a crash
    assert again.add(entries, most=2) == 3
    assert [e["key"] for e in again.between(0, 3)] == ["f0", "f1", "f2", "f3", "f4"]
    assert again.between(1, 2) == [entries[2]]
    # A step that was being written when the stream ended has no name yet, and is not seen.
    (tmp_path / "log" / ".000000003.json.x").write_text(json.dumps(entries[0]))
    assert Found(str(tmp_path / "log")).steps == 3
    assert [again.next_offset([], most=2) for _ in range(4)] == [1, 2, 3, 3]


def test_paths_of_stores():
    assert file_store("/a/b c")[1] == "/a/b c" and file_store("file:/a/b")[1] == "/a/b" == file_store("file:///a/b")[1]


def test_stream_of_files_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head, good = "#,StartDate,EndDate,Duration,Price", '1,2021-01-01,2021-01-02,1,3,"a\nnote"'
    for name, lines in {
        "AAA_1234_12345_01012021.csv": [head, good, good, "end"],
        "_AB_1234_12345_01012021.csv": [head, good, "2,2021-01-01,soon,1,3", "end"],
        "AAC_1234_12345_01012021.csv": [],
        "AAD_1234_12345_01012044.csv": [head, "end"],
        ".hidden": [],
        "AAE_1234_12345_01012021.csv": [head, good],
    }.items():
        (folder / name).write_text("\n".join(lines))
    layout = continuous.Layout(str(tmp_path / "run"))

    def found(query):
        return delimited.stream_files(spark, str(folder), layout.log(query), max_files=2)

    run_until_idle(continuous.names_query(found("names").select("file_name"), layout, TODAY), 90)
    run_until_idle(continuous.arrivals_query(found("arrivals"), layout, TODAY), 90)
    continuous.statuses_query(spark, layout, availableNow=True).awaitTermination()
    run_until_idle(continuous.releases_query(spark, layout, 500), 90)
    batch = ingest_folder(spark, str(folder), TODAY)
    released = spark.read.parquet(layout.released).drop("batch_id")
    assert sorted(map(str, released.collect())) == sorted(map(str, batch.released.collect()))
    assert released.count() == 4
    rejects = continuous.read_file_rejects(spark, layout)
    assert sorted(map(str, rejects.collect())) == sorted(map(str, batch.file_rejects.collect()))
    assert rejects.count() == 3

"""Publication by manifest: repeated, half-written and competing tries appear once."""

import json

import pytest

from subflow.schemas import PROGRESS
from subflow.sinks import manifest
from subflow.sources.published import stream_published
from subflow.sources.staged import append_stream
from subflow.workspace import rename_new, visible_files


@pytest.fixture
def lines(spark):
    def make(*numbers):
        rows = [(f"f{n}", n, None, 1, 1) for n in numbers]
        return spark.createDataFrame(rows, PROGRESS).repartition(4)

    return make


def read(spark, path):
    return sorted(r.arrival for r in manifest.read_published(spark, path, PROGRESS).collect())


def test_a_batch_of_many_files_appears_whole_and_once(spark, lines, tmp_path):
    path = str(tmp_path / "t")
    assert read(spark, path) == []
    for _ in range(2):
        manifest.publish_batch(lines(*range(40)), path, 3, by="arrival")
    manifest.publish_batch(lines(7), path, 4, by="arrival")
    assert read(spark, path) == sorted([*range(40), 7])
    listed = json.loads((tmp_path / "t" / "_manifests" / "arrival=3.json").read_text())["files"]
    assert len(listed) > 1 and spark.read.parquet(path).count() == 41
    assert manifest.is_published(spark, path, 3, "arrival") and not manifest.is_published(spark, path, 5, "arrival")


def test_a_half_written_try_adds_nothing(spark, lines, tmp_path):
    path = str(tmp_path / "t")
    # It died with its files written, and some in place, but without a manifest.
    lines(1, 2).write.parquet(f"{path}/_try-dead")
    lines(1, 2).write.parquet(f"{path}/arrival=0")
    assert read(spark, path) == []
    manifest.publish_batch(lines(1, 2), path, 0, by="arrival")
    assert read(spark, path) == [1, 2]
    assert spark.read.parquet(f"{path}/arrival=0").count() == 2


def test_of_two_tries_at_a_time_one_wins(spark, lines, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    other = lambda: manifest.publish_batch(lines(5), path, 0, by="arrival")

    def late(session, made, to):
        monkeypatch.undo()
        other()  # the other one comes first, between this one's files and its manifest
        return rename_new(session, made, to)

    monkeypatch.setattr(manifest, "rename_new", late)
    manifest.publish_batch(lines(5), path, 0, by="arrival")
    assert read(spark, path) == [5]
    assert spark.read.parquet(f"{path}/arrival=0").count() == 1
    assert len(visible_files(spark, f"{path}/arrival=0")) == len(manifest.published_files(path)[0]["files"])
    assert [p.name for p in (tmp_path / "t" / "_manifests").iterdir() if not p.name.startswith(".")] == ["arrival=0.json"]


def test_a_stream_takes_batches_in_order_and_once(spark, lines, tmp_path):
    path, out = str(tmp_path / "t"), str(tmp_path / "out")

    def run():
        stream = stream_published(spark, path, PROGRESS, str(tmp_path / "log"), max_batches=1)
        query = append_stream(stream, out, str(tmp_path / "ck"), processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()
        return sorted(r.arrival for r in spark.read.parquet(out).collect()), query.lastProgress["batchId"]

    for batch in (2, 10, 1):
        manifest.publish_batch(lines(batch, 100 + batch), path, batch, by="arrival")
    assert run()[0] == [1, 2, 10, 101, 102, 110]
    manifest.publish_batch(lines(11), path, 11, by="arrival")
    manifest.publish_batch(lines(11), path, 11, by="arrival")
    assert run()[0] == [1, 2, 10, 11, 101, 102, 110]

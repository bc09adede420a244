"""Folders of real files: verdicts, rows, statuses and stored rows."""

import datetime
from collections import Counter

import pytest

from subflow.plans.batch import ingest_folder
from subflow.sinks.tables import LONG_TABLE, SHORT_TABLE, read_stored
from subflow.sources import delimited

TODAY = "2026-12-01"
HEAD = "#,StartDate,EndDate,Duration,Price"
# A week for 84, and a fortnight that is said to take three days.
WEEK = "11,2019-03-04,2019-03-11,7,84"
WRONG = "12,2019-03-04,2019-03-18,3,60.5"

FILES = {
    # Two good rows, one for over a year; two that break the rules.
    "AAA_7001_20001_15032019.csv": [
        HEAD, WEEK, WRONG, "13,2019-06-01,2020-06-10,375,990", "14,2019-03-11,2019-03-04,-7,5", "end",
    ],
    # A row without a price, one without a duration, and one that is whole but wrong.
    "AAB_7001_20002_15032019.csv": [HEAD, "11,2019-03-04,2019-03-11,7", WRONG, "15,2019-03-04,2019-03-11", "end"],
    # A date to come, and two end dates that are none.
    "AAC_7001_20003_09092044.csv": [
        HEAD, "21,2019-03-04,soon,7,84", WEEK, "22,2019-03-04,2019-02-29,7,84", "end",
    ],
    "notes.csv": [HEAD, WEEK, "end"],
    # Other column order, a byte order mark, a surplus cell, Windows line ends.
    "AAD_7001_20004_31022021.csv": [
        "\ufeffPrice,#,EndDate,StartDate,Duration\r",
        "48.25,31,2021-07-01,2020-05-27,400,surplus\r",
        '"6","32",2021-05-30,2021-05-27,3\r',
        ",end\r",
    ],
    # No end marker.
    "AAE_7001_20005_15032019xcsv": [HEAD, WEEK],
    # Nothing but the end marker.
    "AAF_7001_20006_15032019.csv": [HEAD, "end"],
    # Rows of every fault, an empty line, two end markers.
    "AAG_7001_20007_30112026.csv": [
        HEAD, "one,2019-03-04,2019-03-11,7,1", "42,2019-13-01,2019-03-11,7,1",
        "43,2019-03-04,later,7,1", "44,2019-03-04,2019-03-11,7.5,1", "45,2019-03-04,2019-03-11,7,cheap",
        "46,2019-03-04,2019-03-11,7,NaN", "47,2019-03-04,2019-03-11,7,-2", "", WEEK, "end", "end",
    ],
    "AAH_7001_20008_15032019.csv": ["Row,StartDate", "51,2019-03-04", "end"],
    "AAI_7001_20009_02122026.csv": [HEAD, WEEK, "end"],
    # Names with characters that a URI escapes.
    "AAJ_7001_20010_15032019 csv": [HEAD, WEEK, "end"],
    "AAK_7001_20011_15032019%csv": [HEAD, WEEK, "end"],
    "AAL_7001_20012_15032019+csv": [HEAD, WEEK, "end"],
    "AAM_7001_20013_15032019\u00e9csv": [HEAD, WEEK, "end"],
    "my file%20.csv": [HEAD, WEEK],
}
ODD = {"AAJ", "AAK", "AAL", "AAM"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("delivered")
    for name, lines in FILES.items():
        (path / name).write_bytes("\n".join(lines).encode())
    return str(path)


@pytest.fixture(scope="module")
def done(spark, folder):
    return ingest_folder(spark, folder, TODAY)


def test_file_verdicts(done):
    assert {r.file_name[:3]: r.errors[0].split(": ")[1] for r in done.file_rejects.collect()} == {
        "not": "filename doesn't correct",
        "my ": "filename doesn't correct",
        "AAC": "date later than now",
        "AAI": "date later than now",
        "AAH": "header has no # column",
    }
    assert "my file%20.csv" in {r.file_name for r in done.file_rejects.collect()}


def test_declared_rows(done):
    got = {r.file_name[:3]: r.countRecord for r in done.file_success.collect()}
    assert got == {"AAA": 4, "AAB": 1, "AAD": 2, "AAF": 0, "AAG": 3} | dict.fromkeys(ODD, 1)


def test_reconciled_files(done):
    got = {r.file_name[:3]: r.countGoodRecords for r in done.statuses.collect()}
    assert got == {"AAA": 2, "AAB": 0, "AAD": 2, "AAF": 0, "AAG": 1} | dict.fromkeys(ODD, 1)


def test_rejected_and_failed_rows(done):
    rejects = Counter((r.file_name[:3], r.reason) for r in done.row_rejects.collect())
    assert rejects == {
        ("AAB", "headers are not the five columns"): 2,
        ("AAG", "headers are not the five columns"): 1,
        ("AAG", "# is not a number"): 1,
        ("AAG", "StartDate is not a date"): 1,
        ("AAG", "EndDate is not a date"): 1,
        ("AAG", "Duration is not a number"): 1,
        ("AAG", "Price is not a number"): 1,
    }
    failed = Counter((r.file_name[:3], r.id) for r in done.row_failures.collect())
    assert set(failed) == {("AAA", 12), ("AAA", 14), ("AAB", 12), ("AAG", 46), ("AAG", 47)}


def test_released_rows(done):
    got = {(r.file_name[:3], r.id): r.is_complete for r in done.released.collect()}
    assert got == {
        ("AAA", 11): True, ("AAA", 13): True, ("AAD", 31): True, ("AAD", 32): True, ("AAE", 11): False,
        ("AAG", 11): True,
    } | {(name, 11): True for name in ODD}


def test_stored_tables(spark, done, tmp_path):
    for _ in range(2):  # a repeated batch replaces itself
        done.store(str(tmp_path / "stored"), batch_id=7)
    short = read_stored(spark, str(tmp_path / "stored"), SHORT_TABLE).collect()
    long = read_stored(spark, str(tmp_path / "stored"), LONG_TABLE).collect()
    day = lambda text: (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days
    week = (day("2019-03-04"), day("2019-03-11"), 7, 84.0)
    assert sorted(map(tuple, short)) == [week] * 7 + [(day("2021-05-27"), day("2021-05-30"), 3, 6.0)]
    assert sorted(map(tuple, long)) == [
        (day("2019-06-01"), day("2020-06-10"), 375, 990.0),
        (day("2020-05-27"), day("2021-07-01"), 400, 48.25),
    ]


def test_a_second_folder_is_added(spark, tmp_path):
    for number, name in enumerate(("one", "two"), start=1):
        (tmp_path / name).mkdir()
        (tmp_path / name / "AAA_7001_20001_15032019.csv").write_text("\n".join([HEAD, *[WEEK] * number, "end"]))
        ingest_folder(spark, str(tmp_path / name), TODAY).store(str(tmp_path / "stored"))
    assert read_stored(spark, str(tmp_path / "stored"), SHORT_TABLE).count() == 3


def test_bad_dates_once_the_file_date_has_come(spark, folder):
    later = ingest_folder(spark, folder, "2045-01-01")
    name = "AAC_7001_20003_09092044.csv"
    assert later.row_rejects.filter(f"file_name = '{name}'").count() == 2
    assert later.file_success.filter(f"file_name = '{name}'").first().countRecord == 1


@pytest.mark.parametrize("nested", [False, True])
def test_odd_names_are_one_name_everywhere(spark, tmp_path, nested):
    names = [n for n in FILES if n[:3] in ODD]
    if nested:
        rows = [(n, line) for n in names for line in (HEAD, WEEK)]
        made = spark.createDataFrame(rows, "file_name string, value string").coalesce(1)
        made.write.partitionBy("file_name").text(str(tmp_path / "in"))
    else:
        (tmp_path / "in").mkdir()
        for n in names:
            (tmp_path / "in" / n).write_text("\n".join([HEAD, WEEK]))
    path = str(tmp_path / "in")
    of = lambda df: {r.file_name for r in df.select("file_name").distinct().collect()}
    assert of(delimited.list_files(spark, path, nested)) == set(names)
    assert of(delimited.read_lines(spark, path, nested)) == set(names)
    for stream in (delimited.stream_lines(spark, path, nested), delimited.stream_names(spark, path, nested)):
        out = str(tmp_path / f"out-{len(stream.columns)}")
        query = stream.select("file_name").writeStream.format("parquet").option("path", out)
        query = query.option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()
        assert of(spark.read.parquet(out)) == set(names)


def test_no_line_is_sorted_for_the_header(spark, folder):
    headers = delimited.file_headers(delimited.read_lines(spark, folder))
    plan = headers._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    partial = plan[plan.index("partial_min") :] if "partial_min" in plan else plan
    assert "Sort [" not in partial.split("FileScan")[0]


def test_every_file_is_listed(spark, folder):
    names = {r.file_name for r in delimited.list_files(spark, folder).collect()}
    assert names == set(FILES)


def test_rejected_files_are_not_read(spark, folder):
    lines = delimited.of_good_files(delimited.read_lines(spark, folder), TODAY)
    names = {r.file_name[:3] for r in lines.select("file_name").distinct().collect()}
    assert names.isdisjoint({"not", "my ", "AAC", "AAI"})
    run = lines._jdf.queryExecution()
    run.toRdd().count()
    scan = run.executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == len(names)


def test_large_file_in_many_splits(spark, tmp_path):
    rows = [f"{i},2019-03-04,2019-03-11,7,{i}" for i in range(20_000)]
    name = "AAA_7001_20001_15032019.csv"
    (tmp_path / name).write_text("\n".join([HEAD, *rows, "end"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = delimited.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        for limit in ({}, {"broadcast_bytes": -1}):
            records = delimited.read_records(spark, str(tmp_path), TODAY, **limit)
            assert records.filter("headers_ok").count() == 20_000
            assert records.count() == 20_001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

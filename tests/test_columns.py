"""Column expressions, value by value."""

import datetime

import pytest
from pyspark.sql import functions as F

from subflow.functions import cells, names

TODAY = "2026-12-01"


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    rows = df.select("i", expression.alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


@pytest.mark.parametrize(
    "name, ok",
    [
        ("KLM_1234_12345_01012021.csv", True),
        ("KLM_1234_12345_01012021xcsv", True),
        ("K_M_1234_12345_01012021.csv", True),
        ("KL_1234_12345_01012021.csv", False),
        ("KLM_1234_12345_1012021.csv", False),
        ("KLM_1234_12345_01012021.csv.gz", False),
        ("xKLM_1234_12345_01012021.csv", False),
        ("other.csv", False),
    ],
)
def test_name_mask(spark, name, ok):
    assert values(spark, [name], names.has_valid_name(F.col("v"))) == [ok]


@pytest.mark.parametrize(
    "digits, date",
    [
        ("01012021", "2021-01-01"),
        ("31022021", "2021-02-28"),
        ("30022020", "2020-02-29"),
        ("31042021", "2021-04-30"),
        ("32012021", None),
        ("00012021", None),
        ("01132021", None),
        ("01012021", "2021-01-01"),
        ("31020000", None),
        ("01010000", None),
    ],
)
def test_mask_date(spark, digits, date):
    name = f"KLM_1234_12345_{digits}.csv"
    want = date and datetime.date.fromisoformat(date)
    assert values(spark, [name], names.file_date(F.col("v"))) == [want]


def test_name_errors(spark):
    good = "KLM_1234_12345_01122026.csv"  # today passes
    late = "KLM_1234_12345_02122026.csv"
    bad = "other.csv"
    odd = "KLM_1234_12345_01132021.csv"
    got = values(spark, [good, late, bad, odd], names.name_errors(F.col("v"), TODAY))
    assert got == [
        None,
        [f"File {late} is not valid: date later than now"],
        [f"File {bad} is not valid: filename doesn't correct"],
        [f"File {odd} is not valid: date in the filename can't be read"],
    ]
    is_good = values(spark, [good, late, bad, odd], names.is_good_name(F.col("v"), TODAY))
    assert is_good == [True, False, False, False]


def test_clock_is_the_default(spark):
    got = values(spark, ["KLM_1234_12345_01019999.csv"], names.name_errors(F.col("v")))
    assert "later than now" in got[0][0]


def test_split_cells(spark):
    lines = ["a,b", ",b", "", '"a,b",c', '"x""y","z\\"q"', 'a,"b', "a,,", '"",x', " a , b "]
    assert values(spark, lines, cells.split_cells(F.col("v"))) == [
        ["a", "b"],
        ["", "b"],
        [""],
        ["a,b", "c"],
        ['x"y', 'z"q'],
        ["a", '"b'],
        ["a", "", ""],
        ["", "x"],
        [" a ", " b "],
    ]


def test_long_quoted_cell(spark):
    cell = "x" * 200_000 + ","
    assert values(spark, [f'"{cell}",y'], cells.split_cells(F.col("v"))) == [[cell, "y"]]


def keyed(spark, header, line):
    df = spark.createDataFrame([(header, line)], "h string, v string")
    df = df.withColumn("h", F.split("h", ",")).withColumn("c", F.split("v", ","))
    columns = cells.cells_by_header(
        F.col("c"), F.size("h"), cells.layouts(F.col("h")), cells.id_positions(F.col("h"))
    )
    return tuple(df.select(*columns).first())


HEAD = "#,StartDate,EndDate,Duration,Price"


@pytest.mark.parametrize(
    "header, line, want",
    [
        (HEAD, "1,s,e,2,3", (True, "1", "s", "e", "2", "3")),
        (HEAD, "1,s,e,2,3,more", (True, "1", "s", "e", "2", "3")),
        (HEAD, "1,s,e,2", (False, "1", None, None, None, None)),
        (HEAD, "end", (False, "end", None, None, None, None)),
        ("Price,Duration,EndDate,StartDate,#", "3,2,e,s,1", (True, "1", "s", "e", "2", "3")),
        # A row as wide as the five is right although the header goes on; a wider one is not.
        (HEAD + ",Note", "1,s,e,2,3", (True, "1", "s", "e", "2", "3")),
        (HEAD + ",Note", "1,s,e,2,3,n", (False, "1", None, None, None, None)),
        # A repeated name: the last cell counts.
        (HEAD + ",Price", "1,s,e,2,3,4", (True, "1", "s", "e", "2", "4")),
        ("#," + HEAD, "0,1,s,e,2,3", (True, "1", "s", "e", "2", "3")),
        ("#," + HEAD, "0", (False, "0", None, None, None, None)),
        # Names are case- and space-sensitive.
        ("#, StartDate,EndDate,Duration,Price", "1,s,e,2,3", (False, "1", None, None, None, None)),
        ("Note,#", "x,end", (False, "end", None, None, None, None)),
        ("Note,#", "x", (False, None, None, None, None, None)),
    ],
)
def test_cells_by_header(spark, header, line, want):
    assert keyed(spark, header, line) == want


def test_whole_numbers(spark):
    texts = ["1", "+3", "-4", "1.0", " 2", "9223372036854775807", "9223372036854775808", "", "x"]
    want = [1, 3, -4, None, None, 9223372036854775807, None, None, None]
    assert values(spark, texts, cells.whole_number(F.col("v"))) == want


def test_decimal_numbers(spark):
    texts = ["1", "1.5e2", " 2 ", "nan", "inf", "-inf", "abc", "", "Infinity", "-Infinity", "1e400"]
    inf = float("inf")
    want = [1.0, 150.0, 2.0, None, None, None, None, None, inf, -inf, inf]
    assert values(spark, texts, cells.decimal_number(F.col("v"))) == want
    assert values(spark, ["NaN"], F.isnan(cells.decimal_number(F.col("v")))) == [True]


def test_iso_dates(spark):
    texts = ["2021-02-28", "2021-02-30", "2021-2-3", "2021", "2021-01-01 10:00", "01.01.2021", "0"]
    want = [datetime.date(2021, 2, 28)] + [None] * 6
    assert values(spark, texts, cells.iso_date(F.col("v"))) == want


def test_epoch_day(spark):
    got = values(spark, ["2021-01-01"], cells.epoch_day(cells.iso_date(F.col("v"))))
    assert got == [18628]

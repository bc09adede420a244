"""Business rules and buckets, at their edges."""

import datetime

import pytest

from subflow.operators import lists, rows
from subflow.schemas import PACKET

D = datetime.date
NAME = "KLM_1234_12345_01062021.csv"


def packet(start="2021-01-01", days=1, duration=None, price=1.0, id=1, name=NAME):
    first = D.fromisoformat(start)
    return (name, id, first, first + datetime.timedelta(days), days if duration is None else duration, price)


def judged(spark, packets, **options):
    df = spark.createDataFrame(packets, PACKET)
    return rows.check_rows(df, "2021-06-30", **options)


@pytest.mark.parametrize(
    "row, ok",
    [
        (packet(), True),
        (packet(start="2021-06-29"), True),
        (packet(start="2021-06-30"), False),  # today is not the past
        (packet(days=0), False),
        (packet(days=-1), False),
        (packet(days=2, duration=3), False),
        (packet(price=0.0), True),
        (packet(price=-0.01), False),
        (packet(price=float("nan")), False),
        (packet(price=float("inf")), True),
        (packet(days=2, duration=2**62), False),
    ],
)
def test_row_rules(spark, row, ok):
    result = judged(spark, [row]).first()
    assert result.is_valid is ok
    assert (result.errors is None) is ok


def test_start_by_file_date_is_opt_in(spark):
    late = packet(start="2021-06-02")  # the file is of 2021-06-01
    on_day = packet(start="2021-06-01")
    assert judged(spark, [late]).first().is_valid
    strict = judged(spark, [late, on_day], start_by_file_date=True).orderBy("startDate").collect()
    assert [r.is_valid for r in strict] == [True, False]


def test_error_text(spark):
    error = judged(spark, [packet(days=0, price=150.0)]).first().errors
    assert error == [
        'Expected valid SubscriptionData but got: {"id":1,"startDate":"2021-01-01",'
        f'"endDate":"2021-01-01","duration":0,"price":150.0}} from {NAME}'
    ]


def test_split_keeps_every_row_once(spark):
    checked = judged(spark, [packet(id=i, price=float(i - 2)) for i in range(5)])
    good, bad = rows.good_rows(checked).collect(), rows.failed_rows(checked).collect()
    assert sorted(r.id for r in good) == [2, 3, 4]
    assert sorted(r.id for r in bad) == [0, 1]


@pytest.mark.parametrize("days, long", [(364, False), (365, False), (366, True), (367, True)])
def test_bucket_edge(spark, days, long):
    df = spark.createDataFrame([packet(start="2020-01-01", days=days)], PACKET)
    assert lists.stored_items(df).first().isMoreYear is long


def test_lists(spark):
    df = spark.createDataFrame(
        [packet(id=2), packet(id=1), packet(id=3, days=400), packet(id=9, name="other")], PACKET
    )
    got = {
        (r.file_name, r.isMoreYear): [i.id for i in r.list] for r in lists.bucket_lists(df).collect()
    }
    assert got == {(NAME, False): [1, 2], (NAME, True): [3], ("other", False): [9]}
    items = lists.explode_lists(lists.bucket_lists(df))
    assert sorted(tuple(r) for r in lists.long_rows(items).collect()) == [(18628, 19028, 400, 1.0)]
    assert lists.short_rows(items).count() == 3

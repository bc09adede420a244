"""JSON records."""

import datetime

from subflow.sources import json_rows

GOOD = '{"id":70,"startDate":"2018-05-30","endDate":"2018-06-13","duration":14,"price":31.5}'


def test_json_lines(spark, tmp_path):
    bad = [
        GOOD.replace('"2018-06-13"', '"2018-06-31"'),
        GOOD.replace('"2018-06-13"', "20180613"),
        GOOD.replace("31.5", '"31.5"'),
        GOOD.replace("31.5", '"NaN"'),
        GOOD.replace("31.5", "null"),
        GOOD.replace(',"price":31.5', ""),
        GOOD.replace('"id":70', '"id":"70"'),
        GOOD.replace('"duration":14', '"duration":true'),
        "",
        "no json",
    ]
    also_good = [
        GOOD.replace('"id":70', '"id":71.9'),
        GOOD.replace('"id":70', '"extra":[1],"id":72'),
        GOOD.replace('"id":70', '"id":73').replace("31.5", "3.15e1"),
        GOOD.replace('"id":70', '"id":9007199254740993'),
    ]
    (tmp_path / "lines.json").write_text("\n".join([GOOD, *also_good, *bad]))
    lines = spark.read.text(str(tmp_path))
    got = json_rows.read_json_rows(spark, str(tmp_path)).orderBy("id").collect()
    day = datetime.date
    assert [tuple(r) for r in got] == [
        (i, day(2018, 5, 30), day(2018, 6, 13), 14, 31.5) for i in (70, 71, 72, 73, 9007199254740993)
    ]
    assert json_rows.json_rejects(lines).count() == len(bad)


def test_one_parse(spark):
    rows = json_rows.json_rows(spark.createDataFrame([(GOOD,)], "value string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_json_round_trip(spark):
    lines = spark.createDataFrame([(GOOD,)], "value string")
    again = json_rows.as_json_lines(json_rows.json_rows(lines)).first().value
    assert again == GOOD

"""Cells in plain and in odd forms; the writer of deliveries stays small enough to be compiled."""

import contextlib
import io
import re

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from subflow.functions.cells import decimal_number, iso_date, whole_number
from subflow.sources import orders


def test_odd_cells(spark):
    texts = {
        "2000-02-03": ("2000-02-03", None, None), "2000-02-30": (None, None, None), "2000-02-3T": (None, None, None),
        "2000-02-3 ": (None, None, None), " 2000-02-03": (None, None, None), "+12000-01-01": ("+12000-01-01", None, None),
        "2000-02-T3": (None, None, None), "2000-1--03": (None, None, None), "12": (None, 12, 12.0), "+12": (None, 12, 12.0),
        "-12": (None, -12, -12.0), "007": (None, 7, 7.0), "1.5": (None, None, 1.5), "5 ": (None, None, 5.0),
        " 5": (None, None, 5.0), "9223372036854775808": (None, None, 9223372036854775808.0), "٣": (None, None, None),
        "dear": (None, None, None), "Infinity": (None, None, float("inf")), "infinity": (None, None, None), "-:": (None, None, None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = [iso_date(F.col("t")).cast("string"), whole_number(F.col("t")), decimal_number(F.col("t"))]
    assert {r[0]: tuple(r[1:]) for r in df.select("t", *made).collect()} == texts


def test_the_writer_of_deliveries_is_compiled(spark, tmp_path, monkeypatch):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    written = []
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: written.append(self._df))
    orders.write_deliveries(spark, "/root/testdata/sf0.001", str(tmp_path / "out"), 2)
    said = io.StringIO()
    # An adaptive plan has no code before it runs.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(said):
            written[0].select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) <= 8000

"""Order tables as deliveries: the given tables read as if they had come as files.

In :func:`records` one order is one file and its line items are the rows. In
:func:`write_deliveries` the orders of a status, priority and year make one
file, written out as text, and in :func:`write_flat_files` those of a day. Some rows and names are made faulty by rules on the
keys, so that every check has something to find.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.functions.cells import once
from subflow.schemas import COLUMNS, END_MARK, RECORD
from subflow.sources.discovery import file_store, write_whole

AS_OF = "2000-06-30"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def row_count(spark: SparkSession, sf_dir: str) -> int:
    return _lineitem(spark, sf_dir).count()


def _digits(number: Column, n: int) -> Column:
    return F.lpad((number % 10**n).cast("string"), n, "0")


def _file_name() -> Column:
    key = F.col("o_orderkey")
    date = F.when(key % 37 == 0, F.lit("31022000")).otherwise(
        F.date_format("o_orderdate", "ddMMyyyy")
    )
    return F.when(key % 17 == 0, F.concat(F.lit("BAD_"), key, F.lit(".txt"))).otherwise(
        F.concat(
            F.lit("PR"),
            "o_orderstatus",
            F.lit("_"),
            _digits(F.col("o_custkey"), 4),
            F.lit("_"),
            _digits(key, 5),
            F.lit("_"),
            date,
            F.lit(".csv"),
        )
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: its file name and whether the file has its end marker."""
    return _orders(spark, sf_dir).select(
        (F.col("o_orderkey") % 31 != 0).alias("has_end"), once(file_name=_file_name())
    )


def _row_cells() -> dict[str, Column]:
    part, ship = F.col("l_partkey"), F.col("l_shipdate").cast("date")
    days = (F.col("l_quantity") * 15).cast("int")
    end = F.when(part % 7 == 0, ship).otherwise(F.date_add(ship, days))
    price = F.col("l_extendedprice")
    return {
        "id_text": F.when(part % 43 == 0, F.lit("first")).otherwise(F.col("l_linenumber").cast("string")),
        "start_text": F.when(part % 23 == 0, F.lit("2000-02-30")).otherwise(ship.cast("string")),
        "end_text": end.cast("string"),
        "duration_text": F.when(part % 47 == 0, F.lit("long")).otherwise(
            (days + F.when(part % 11 == 0, 1).otherwise(0)).cast("string")
        ),
        "price_text": F.when(part % 29 == 0, None)
        .when(part % 41 == 0, F.lit("dear"))
        .when(part % 19 == 0, F.lit("NaN"))
        .otherwise(F.when(part % 13 == 0, -price).otherwise(price).cast("string")),
    }


def _rows_of(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Line items with their order. Both grow together, so neither is ever broadcast."""
    items = _lineitem(spark, sf_dir)
    return items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items and end markers as records; a cell that is missing is null."""
    orders = _orders(spark, sf_dir).select(
        "o_orderkey", (F.col("o_orderkey") % 31 != 0).alias("end"), once(file_name=_file_name())
    )
    cells = _row_cells()
    complete = F.lit(True)
    for name in cells:
        complete = complete & F.col(name).isNotNull()
    rows = (
        _rows_of(spark, sf_dir, orders)
        .select("file_name", *[c.alias(name) for name, c in cells.items()])
        .select("file_name", complete.alias("headers_ok"), *cells)
    )
    ends = orders.filter("end").select(
        "file_name",
        F.lit(False).alias("headers_ok"),
        F.lit(END_MARK).alias("id_text"),
        *[F.lit(None).cast("string").alias(name) for name in list(cells)[1:]],
    )
    return rows.unionByName(ends).to(RECORD)


# The files written out: by priority, the header line, the cells of a row in that
# order, and the end marker. Priority 4 rows have a surplus cell with a comma in it;
# priority 3 files name a sixth column that their rows do not have.
_LAYOUTS = {
    "1": ("#,StartDate,EndDate,Duration,Price", "id start end duration price", END_MARK),
    "2": ("Price,#,EndDate,StartDate,Duration", "price id end start duration", f",{END_MARK}"),
    "3": ("#,StartDate,EndDate,Duration,Price,Note", "id start end duration price", END_MARK),
    "4": ("#,Price,StartDate,EndDate,Duration", "id price start end duration", END_MARK),
    "5": ("#,StartDate,EndDate,Duration,Price", "id start end duration price", END_MARK),
}


def _delivery_name(prio: Column) -> Column:
    year = F.year("o_orderdate")
    return F.when(
        (F.col("o_orderstatus") == "P") & (prio == "5"),
        F.concat(F.lit("BAD_"), year, F.lit(".txt")),
    ).otherwise(
        F.concat(
            F.lit("PR"),
            "o_orderstatus",
            F.lit("_"),
            F.lpad(prio, 4, "0"),
            F.lit("_"),
            _digits(year, 5),
            F.lit("_"),
            F.concat(F.lit("0101"), year),
            # Any character may stand before "csv".
            F.when(prio == "1", F.lit(" ")).when(prio == "2", F.lit("%")).when(prio == "3", F.lit("+")).otherwise(F.lit(".")),
            F.lit("csv"),
        )
    )


def write_deliveries(spark: SparkSession, sf_dir: str, path: str, parts: int = 1) -> None:
    """Write the delivery files; ``parts`` part files for each, so none is one task's work.

    Files of every fifth year get no end marker.
    """
    prio = F.substring("o_orderpriority", 1, 1)
    orders = _orders(spark, sf_dir).select(
        "o_orderkey",
        prio.alias("prio"),
        _delivery_name(prio).alias("file_name"),
        (F.year("o_orderdate") % 5 != 0).alias("end"),
    )
    # Each cell is made once and then put where the layouts have it; written into every layout,
    # they make a method that is too large for the JVM to compile.
    made = {name.removesuffix("_text"): c for name, c in _row_cells().items()}
    made["is_missing"] = made["price"].isNull()
    made["price"] = F.coalesce(made["price"], F.col("l_extendedprice").cast("string"))
    cells = {name: F.col(f"cell_{name}") for name in made}
    missing = cells["is_missing"]

    header = close = None
    line = None
    for digit, (header_line, order, end_mark) in _LAYOUTS.items():
        names = order.split()
        full = [cells[n] for n in names] + ([F.lit('"x, y"')] if digit == "4" else [])
        text = F.when(missing, F.concat_ws(",", *[cells[n] for n in names[:-1]])).otherwise(
            F.concat_ws(",", *full)
        )
        is_digit = F.col("prio") == digit
        header = F.when(is_digit, header_line) if header is None else header.when(is_digit, header_line)
        close = F.when(is_digit, end_mark) if close is None else close.when(is_digit, end_mark)
        line = F.when(is_digit, text) if line is None else line.when(is_digit, text)

    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)).cast("int")
    rows = _rows_of(spark, sf_dir, orders).select(
        "file_name", "prio", part.alias("part"), once(**{f"cell_{name}": c for name, c in made.items()})
    )
    rows = rows.select("file_name", "part", F.lit(1).alias("seq"), line.alias("value"))
    file_lines = orders.select("file_name", "prio", "end").distinct()
    headers = file_lines.select(
        "file_name",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(0).alias("seq"),
        header.alias("value"),
    )
    ends = file_lines.filter("end").select(
        "file_name", F.lit(0).alias("part"), F.lit(2).alias("seq"), close.alias("value")
    )
    (
        rows.unionByName(headers)
        .unionByName(ends)
        .repartition("file_name", "part")
        .sortWithinPartitions("file_name", "seq")
        .select("file_name", "value")
        .write.partitionBy("file_name")
        .text(path)
    )


# Line items of a day's file, about; beyond, the day has several.
_FLAT_ROWS = 20_000
_FIRST_DAY = "1992-01-01"


def write_flat_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """One file per order date, all in one folder; some with names that Spark's sources pass over.

    By the day's number: every 13th file is empty, every 17th begins with ``_`` (a good
    name), every 19th with ``.`` (a bad one), and every 23rd has no end marker. Some rows
    have a surplus cell with a line break in quotes.
    """
    day = F.col("o_orderdate").cast("date")
    number = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    days = _orders(spark, sf_dir).agg(F.countDistinct(day)).first()[0] or 1
    chunks = 1 + row_count(spark, sf_dir) // (days * _FLAT_ROWS)
    chunk = F.pmod(F.xxhash64("o_orderkey"), F.lit(chunks))
    name = F.concat(
        F.when(number % 19 == 0, F.lit(".")).otherwise(F.lit("")),
        F.when(number % 17 == 0, F.lit("_L")).otherwise(F.lit("FL")),
        _digits(chunk, 1),
        F.lit("_"),
        _digits(number, 4),
        F.lit("_"),
        _digits(chunk, 5),
        F.lit("_"),
        F.date_format(day, "ddMMyyyy"),
        F.lit(".csv"),
    )
    orders = _orders(spark, sf_dir).select(
        "o_orderkey", name.alias("file_name"), (number % 13 == 0).alias("is_empty"), (number % 23 != 0).alias("end")
    )
    cells = _row_cells()
    short = F.concat_ws(",", *[cells[c] for c in ("id_text", "start_text", "end_text", "duration_text")])
    note = F.when(F.col("l_partkey") % 31 == 0, F.lit(',"of, two\n""lines"""')).otherwise(F.lit(""))
    line = F.when(cells["price_text"].isNull(), short).otherwise(F.concat(short, F.lit(","), cells["price_text"], note))
    columns = ["file_name", "is_empty", "end", "l_orderkey", "l_linenumber", "value"]
    rows = _rows_of(spark, sf_dir, orders).withColumn("value", line).select(*columns)
    # A day may have orders without line items.
    bare = orders.drop("o_orderkey").distinct()
    rows = rows.unionByName(bare, allowMissingColumns=True)

    def write(group):
        group = group.sort_values(["l_orderkey", "l_linenumber"])
        first = group.iloc[0]
        closing = [END_MARK] if first["end"] else []
        text = "" if first["is_empty"] else "\n".join([",".join(COLUMNS), *group["value"].dropna(), *closing])
        store, folder = file_store(path)
        write_whole(store, f"{folder}/{first['file_name']}", text.encode(), making=f"{folder}-making")
        return group[["file_name"]].head(1)

    rows.groupBy("file_name").applyInPandas(write, "file_name string").count()


def write_json_rows(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Line items as JSON lines; some without a price, some with a quoted one."""
    cells = _row_cells()
    part = F.col("l_partkey")
    price = F.col("l_extendedprice")
    row = lambda p: F.to_json(
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            cells["start_text"].alias("startDate"),
            cells["end_text"].alias("endDate"),
            cells["duration_text"].try_cast("bigint").alias("duration"),
            p.alias("price"),
        )
    )
    value = (
        F.when(part % 29 == 0, row(F.lit(None).cast("double")))
        .when(part % 19 == 0, row(price.cast("string")))
        .otherwise(row(price))
    )
    _lineitem(spark, sf_dir).select(value.alias("value")).write.text(path)

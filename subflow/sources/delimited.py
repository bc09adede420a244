"""Delimited text files, each read by its own header line.

A delivery is a file in a folder, or a folder ``file_name=<name>`` of part files
that each start with a header line, as Spark writes one large delivery.

Deliveries come as a listing, which has every file, and are then read by byte ranges: a
first pass over the files reads the first bytes of each for its header, and the text is
scanned once (files of several ranges, and only these, are also passed over for the quotes
in them, see ``ranges``). Records know the byte of their file that they begin at. Nothing
is sorted or shuffled but a line per file and range.

Lines that come from elsewhere, as from Spark's own text source, are read as well, where
only Spark can open the files: one line is one record then, empty and hidden files are not
seen, and the text is scanned three times.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.functions.cells import cells_by_header, id_positions, layouts, once, split_cells
from subflow.functions.names import no_id_column_error
from subflow.operators.files import of_good_files
from subflow.operators.spread import attach_per_key
from subflow.schemas import ID, RECORD
from subflow.sources.listing import list_paths, stream_paths
from subflow.sources.ranges import RANGE_BYTES, first_records, ranges_of, read_ranges
from subflow.workspace import staged

BYTE_ORDER_MARK = "\ufeff"


def _decoded(name: Column) -> Column:
    """``%20`` and the like as the characters they stand for; a plus sign stays one."""
    plain = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.coalesce(plain, name)


def _name(path: Column, is_uri: bool) -> Column:
    """The delivery's name, as it is in the folder, from a file's path or its URI.

    A folder ``file_name=<name>`` has some characters escaped once more, by its writer.
    """
    name = lambda c: _decoded(c) if is_uri else c
    folder = F.regexp_extract(path, r"/file_name=([^/]+)/[^/]+$", 1)
    own = F.element_at(F.split(path, "/"), -1)
    return F.when(folder != "", _decoded(name(folder))).otherwise(name(own))


def _lines(reader, path: str, nested: bool) -> DataFrame:
    text = reader.format("text").option("recursiveFileLookup", str(nested).lower()).load(path)
    return text.select(
        "value",
        _name(F.col("_metadata.file_path"), is_uri=True).alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def read_lines(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """All lines of the files in a folder."""
    return _lines(spark.read, path, nested)


def stream_lines(
    spark: SparkSession, path: str, nested: bool = False, max_files: int | None = None
) -> DataFrame:
    """The lines of the files now in a folder, then of each new one; every file once."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _lines(reader, path, nested)


def _files(paths: DataFrame) -> DataFrame:
    return paths.select(_name(F.col("file_path"), is_uri=False).alias("file_name"), "store", "file_path", "length")


def read_files(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Every physical file of a folder: its delivery's name, where it is, its length. None is opened."""
    return _files(list_paths(spark, path, nested))


def stream_files(
    spark: SparkSession, path: str, log: str, nested: bool = False, max_files: int | None = None
) -> DataFrame:
    """The files now in a folder, then each new one, once; ``log`` is a folder of this stream's own."""
    return _files(stream_paths(spark, path, log, nested, max_files))


def list_files(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """One row per delivery in a folder; no content is read."""
    return read_files(spark, path, nested).select("file_name").distinct()


def stream_names(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """The names of the files now in a folder, then of each new one; no content is read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    listing = reader.option("recursiveFileLookup", str(nested).lower()).load(path)
    return listing.select(_name(F.col("path"), is_uri=False).alias("file_name"))


def _is_lines(arrived: DataFrame) -> bool:
    return "value" in arrived.columns


def file_headers(arrived: DataFrame) -> DataFrame:
    """Per physical file: its first line, and what that says of the columns."""
    found = _first_lines(arrived) if _is_lines(arrived) else first_records(arrived).withColumn("lines", F.col("length"))
    header = split_cells(F.ltrim(F.coalesce("header_line", F.lit("")), F.lit(BYTE_ORDER_MARK)))
    place = [c for c in ("store", "length") if c in found.columns]
    return found.withColumn("header", header).select(
        "file_path",
        "file_name",
        "header_line",
        F.size("header").alias("header_size"),
        layouts(F.col("header")).alias("at"),
        id_positions(F.col("header")).alias("id_at"),
        "lines",
        *place,
    )


def _first_lines(lines: DataFrame) -> DataFrame:
    """Each file's first line and line count, from its lines.

    A file's first line is the first that the task with its first block reads. Its number
    is a least of numbers, which is combined without sorting the lines. The text of a
    first line is needed only if it names the # column, so a second scan passes on no
    other lines than those with that character; both scans number lines alike.
    """
    at_start = F.col("block_start") == 0
    numbered = lines.withColumn("seq", F.monotonically_increasing_id())
    first = numbered.groupBy("file_path", "file_name").agg(
        F.min(F.when(at_start, F.col("seq"))).alias("seq"), F.count("*").alias("lines")
    )
    named = numbered.filter(at_start & F.contains("value", F.lit(ID)))
    named = named.select("file_path", "seq", F.col("value").alias("header_line"))
    return first.join(named, ["file_path", "seq"], "left")


def without_id_column(headers: DataFrame) -> DataFrame:
    """Files that cannot be read because no column is named #, as failed files."""
    return (
        headers.filter(F.size("id_at") == 0)
        .select("file_name", no_id_column_error(F.col("file_name")).alias("errors"))
        .distinct()
    )


def header_records(arrived: DataFrame, headers: DataFrame, range_bytes: int = RANGE_BYTES, **spread) -> DataFrame:
    """Lines, or what stands in files, as records keyed by their file's header.

    ``headers`` are staged. A line that repeats the header line is never data. Records of
    files have ``record_at``, the byte that they begin at.
    """
    readable = headers.filter(F.size("id_at") > 0)
    if _is_lines(arrived):
        lines, readable = arrived.select("value", "file_name", "file_path"), readable.drop("file_name")
    else:
        total = readable.agg(F.sum("length")).first()[0] or 0
        ranges = ranges_of(readable.select("store", "file_path", "length"), range_bytes)
        lines = read_ranges(ranges, total).withColumnRenamed("at", "record_at")
        readable = readable.drop("store", "length")
    keyed = attach_per_key(lines, readable, on="file_path", weight="lines", **spread)
    keyed = keyed.filter(F.col("value") != F.col("header_line"))
    places = [c for c in ("record_at",) if c in keyed.columns]
    cells = keyed.select(
        "file_name", *places, "header_size", "at", "id_at", once(cells=split_cells(F.col("value")))
    )
    picked = cells.select(
        "file_name",
        *places,
        *cells_by_header(F.col("cells"), F.col("header_size"), F.col("at"), F.col("id_at")),
    )
    return picked.select(*RECORD.fieldNames(), *places)


def read_records(
    spark: SparkSession, path: str, as_of=None, nested: bool = False, **spread
) -> DataFrame:
    """Records of the files with a good name; the others are not opened."""
    good = of_good_files(read_files(spark, path, nested), as_of)
    headers = staged(file_headers(good), "headers")
    return header_records(good, headers, is_staged=True, **spread)

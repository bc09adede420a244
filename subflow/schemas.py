"""Schemas of the stage tables. Field names and types are fixed values."""

from pyspark.sql import types as T

# The five columns of a delivered file, and the cell that closes it.
ID, START, END, DURATION, PRICE = "#", "StartDate", "EndDate", "Duration", "Price"
COLUMNS = (ID, START, END, DURATION, PRICE)
END_MARK = "end"

_TEXT, _INT, _LONG, _DOUBLE, _FLAG, _DATE = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.DateType(),
)
_ERRORS = T.ArrayType(T.StringType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One line of a file as text cells, after lookup by the file's own header.
RECORD = _schema(
    file_name=_TEXT,
    headers_ok=_FLAG,
    id_text=_TEXT,
    start_text=_TEXT,
    end_text=_TEXT,
    duration_text=_TEXT,
    price_text=_TEXT,
)

SUBSCRIPTION = _schema(id=_LONG, startDate=_DATE, endDate=_DATE, duration=_LONG, price=_DOUBLE)
# Dates as days since 1970-01-01, as the stored tables hold them.
STORED_ITEM = _schema(id=_LONG, startDate=_LONG, endDate=_LONG, duration=_LONG, price=_DOUBLE)
STORED_ROW = T.StructType(STORED_ITEM.fields[1:])

PACKET = T.StructType([*_schema(file_name=_TEXT).fields, *SUBSCRIPTION.fields])
ROW_REJECT = T.StructType(
    [RECORD["file_name"], *RECORD.fields[2:], *_schema(reason=_TEXT).fields]
)
FILE_SUCCESS = _schema(file_name=_TEXT, countRecord=_LONG)
FILE_FAIL = _schema(file_name=_TEXT, errors=_ERRORS)
ROW_STATUS = T.StructType([*PACKET.fields, *_schema(is_valid=_FLAG, errors=_ERRORS).fields])
COLLECTOR_STATUS = _schema(file_name=_TEXT, countGoodRecords=_LONG)
# The list of a file's bucket, or a numbered part of it.
BUCKET_LIST = _schema(isMoreYear=_FLAG, part=_INT, parts=_INT, list=T.ArrayType(STORED_ITEM))

# A record with all that is known of it. Where it stood in its file: the byte it began at,
# null if that isn't known.
CHECKED = T.StructType(
    [
        *RECORD.fields,
        *_schema(record_at=_LONG).fields,
        *_schema(is_end=_FLAG).fields,
        *SUBSCRIPTION.fields,
        *_schema(reason=_TEXT, is_valid=_FLAG, errors=_ERRORS).fields,
    ]
)

# What one arrival (one batch of staged rows) adds to a file.
PROGRESS = _schema(file_name=_TEXT, arrival=_LONG, countRecord=_LONG, seen=_LONG, good=_LONG)
RELEASE = _schema(file_name=_TEXT, arrivals=T.ArrayType(_LONG), held=_LONG, is_complete=_FLAG)
# The same to the row: without the first ``skip`` good rows of the first arrival, and of the
# last arrival those up to ``upto`` (all, if null).
RELEASE_CUT = T.StructType([*RELEASE.fields, *_schema(skip=_LONG, upto=_LONG).fields])
# A reconciled file; or one that was idle for too long with counts that did not meet.
RECONCILED = T.StructType([*COLLECTOR_STATUS.fields, *_schema(is_reconciled=_FLAG).fields])

# Released rows: complete file, or let go by the timer.
RELEASED = T.StructType([*PACKET.fields, *_schema(is_complete=_FLAG).fields])

PACKET_COLUMNS = PACKET.fieldNames()
ITEM_COLUMNS = STORED_ITEM.fieldNames()
STORED_COLUMNS = STORED_ROW.fieldNames()

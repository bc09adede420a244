"""The registered queries as SQL over the given tables, for comparison in DuckDB."""

AS_OF = "DATE '2000-06-30'"

# One order as one file.
_FILES = f"""
files AS (
  SELECT o_orderkey, o_orderkey % 31 <> 0 AS has_end,
    CASE WHEN o_orderkey % 17 = 0 THEN 'BAD_' || o_orderkey || '.txt'
    ELSE 'PR' || o_orderstatus || '_' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')
      || '_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') || '_'
      || CASE WHEN o_orderkey % 37 = 0 THEN '31022000'
              ELSE strftime(o_orderdate, '%d%m%Y') END || '.csv'
    END AS file_name
  FROM orders),
"""

# The verdict on file names; the date clamps to the end of its month.
_VERDICT = rf"""
split_names AS (
  SELECT *, regexp_matches(file_name, '^\w{{3}}_\d{{4}}_\d{{5}}_\d{{8}}.csv$') AS name_ok,
    regexp_extract(file_name, '(\d{{8}})', 1) AS digits
  FROM files),
dated_names AS (
  SELECT *, TRY_CAST(substr(digits, 1, 2) AS INTEGER) AS dd,
    CAST(try_strptime('01' || substr(digits, 3, 6), '%d%m%Y') AS DATE) AS first_day
  FROM split_names),
named AS (
  SELECT *, CASE WHEN dd BETWEEN 1 AND 31 AND year(first_day) >= 1
    THEN CAST(first_day + CAST(least(dd, day(last_day(first_day))) - 1 AS INTEGER) AS DATE)
    END AS file_date
  FROM dated_names),
verdicts AS (
  SELECT *, CASE
    WHEN NOT name_ok THEN 'File ' || file_name || ' is not valid: filename doesn''t correct'
    WHEN file_date IS NULL
      THEN 'File ' || file_name || ' is not valid: date in the filename can''t be read'
    WHEN file_date > {AS_OF} THEN 'File ' || file_name || ' is not valid: date later than now'
    END AS error
  FROM named),
"""

_CELLS = """
cells AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_partkey % 43 = 0 THEN 'first' ELSE CAST(l_linenumber AS VARCHAR) END AS id_text,
    CASE WHEN l_partkey % 23 = 0 THEN '2000-02-30'
      ELSE strftime(l_shipdate, '%Y-%m-%d') END AS start_text,
    strftime(CASE WHEN l_partkey % 7 = 0 THEN CAST(l_shipdate AS DATE)
      ELSE CAST(CAST(l_shipdate AS DATE) + CAST(15 * l_quantity AS INTEGER) AS DATE) END,
      '%Y-%m-%d') AS end_text,
    CASE WHEN l_partkey % 47 = 0 THEN 'long' ELSE CAST(CAST(15 * l_quantity AS BIGINT)
      + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS duration_text,
    CASE WHEN l_partkey % 29 = 0 THEN NULL
      WHEN l_partkey % 41 = 0 THEN 'dear'
      WHEN l_partkey % 19 = 0 THEN 'NaN'
      WHEN l_partkey % 13 = 0 THEN CAST(-l_extendedprice AS VARCHAR)
      ELSE CAST(l_extendedprice AS VARCHAR) END AS price_text
  FROM lineitem),
"""

# Records of files with a good name, up to the verdict on each row.
_JUDGED = f"""
records AS (
  SELECT file_name, has_end, file_date, c.*, price_text IS NOT NULL AS headers_ok
  FROM verdicts JOIN cells c ON o_orderkey = l_orderkey WHERE error IS NULL),
typed AS (
  SELECT *, TRY_CAST(id_text AS BIGINT) AS id, TRY_CAST(start_text AS DATE) AS sd,
    TRY_CAST(end_text AS DATE) AS ed, TRY_CAST(duration_text AS BIGINT) AS duration,
    TRY_CAST(price_text AS DOUBLE) AS price
  FROM records),
reasoned AS (
  SELECT *, CASE WHEN NOT headers_ok THEN 'headers are not the five columns'
    WHEN id IS NULL THEN '# is not a number'
    WHEN sd IS NULL THEN 'StartDate is not a date'
    WHEN ed IS NULL THEN 'EndDate is not a date'
    WHEN duration IS NULL THEN 'Duration is not a number'
    WHEN price IS NULL THEN 'Price is not a number' END AS reason
  FROM typed),
packets AS (
  SELECT file_name, has_end, file_date, l_orderkey, l_linenumber, id, sd, ed, CAST(sd AS VARCHAR) AS "startDate",
    CAST(ed AS VARCHAR) AS "endDate", duration, price,
    sd < {AS_OF} AND sd < ed AND ed - sd = duration AND duration >= 0
      AND NOT isnan(price) AND price >= 0 AS is_valid
  FROM reasoned WHERE reason IS NULL),
"""

_ROWS = "WITH " + _FILES + _VERDICT + _CELLS + _JUDGED
_ROW = 'file_name, id, "startDate", "endDate", duration, price'

# Statuses as they arrive: of some files, that of row 1 is lost or that of row 2 comes twice.
_SENT = """CASE WHEN id = 1 AND TRY_CAST(substr(file_name, 10, 5) AS INTEGER) % 5 = 0 THEN 0
    WHEN id = 2 AND TRY_CAST(substr(file_name, 10, 5) AS INTEGER) % 7 = 0 THEN 2 ELSE 1 END"""
_ALL_SENT = "1"


def _per_file(times: str) -> str:
    return f"""
marked AS (
  SELECT DISTINCT file_name FROM verdicts WHERE error IS NULL AND has_end),
success AS (
  SELECT m.file_name, count(p.file_name) AS "countRecord"
  FROM marked m LEFT JOIN packets p USING (file_name) GROUP BY m.file_name),
sent AS (SELECT file_name, id, is_valid, {times} AS times FROM packets),
counts AS (
  SELECT file_name, sum(times) AS seen, sum(CASE WHEN is_valid THEN times ELSE 0 END) AS good,
    sum(CASE WHEN id % 2 = 0 THEN times ELSE 0 END) AS seen_even,
    sum(CASE WHEN id % 2 = 0 AND is_valid THEN times ELSE 0 END) AS good_even
  FROM sent GROUP BY file_name),
statuses AS (
  SELECT file_name, CAST(coalesce(good, 0) AS BIGINT) AS "countGoodRecords"
  FROM success LEFT JOIN counts USING (file_name) WHERE coalesce(seen, 0) = "countRecord"),
met AS (
  SELECT file_name, CAST(coalesce(CASE WHEN seen_even = "countRecord" THEN good_even ELSE good END, 0) AS BIGINT)
    AS "countGoodRecords"
  FROM success LEFT JOIN counts USING (file_name)
  WHERE coalesce(seen_even, 0) = "countRecord"
    OR (coalesce(seen_even, 0) < "countRecord" AND coalesce(seen, 0) >= "countRecord")),
held AS (
  SELECT file_name, count(*) AS held, count(*) FILTER (WHERE id % 2 = 0) AS held_even
  FROM packets WHERE is_valid GROUP BY file_name),
release AS (
  SELECT file_name, held, held_even,
    coalesce(held = "countGoodRecords", FALSE) AS is_complete,
    coalesce(held_even = "countGoodRecords", FALSE) AS even_complete
  FROM held LEFT JOIN statuses USING (file_name)),
"""


_PER_FILE = _per_file(_ALL_SENT)
_STATUSES = _ROWS + _PER_FILE
_ARRIVED = _ROWS + _per_file(_SENT)

_ITEMS = """
items AS (
  SELECT file_name, id, CAST(sd - DATE '1970-01-01' AS BIGINT) AS "startDate",
    CAST(ed - DATE '1970-01-01' AS BIGINT) AS "endDate", duration, price,
    duration > 365 AS "isMoreYear"
  FROM packets WHERE is_valid)
"""
_STORED = '"startDate", "endDate", duration, price'


def _failure() -> str:
    price = "CASE WHEN isnan(price) THEN '\"NaN\"' ELSE CAST(price AS VARCHAR) END"
    return (
        "'Expected valid SubscriptionData but got: {\"id\":' || id || ',\"startDate\":\"' "
        "|| \"startDate\" || '\",\"endDate\":\"' || \"endDate\" || '\",\"duration\":' "
        f"|| duration || ',\"price\":' || {price} || '}} from ' || file_name"
    )


# Orders of one status, priority and year as one written file.
_DELIVERIES = """
files AS (
  SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS prio,
    year(o_orderdate) % 5 <> 0 AS has_end,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '5%'
      THEN 'BAD_' || year(o_orderdate) || '.txt'
    ELSE 'PR' || o_orderstatus || '_' || lpad(substr(o_orderpriority, 1, 1), 4, '0') || '_'
      || lpad(CAST(year(o_orderdate) AS VARCHAR), 5, '0') || '_0101'
      || year(o_orderdate) || CASE substr(o_orderpriority, 1, 1)
        WHEN '1' THEN ' ' WHEN '2' THEN '%' WHEN '3' THEN '+' ELSE '.' END || 'csv'
    END AS file_name
  FROM orders),
"""
_CSV = "WITH " + _DELIVERIES + _VERDICT + _CELLS + _JUDGED

# Orders of one day as one file of a flat folder.
_FLAT = (
    "WITH "
    + """
days AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
    date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS k
  FROM orders),
files AS (
  SELECT o_orderkey, k % 13 = 0 AS is_empty, k % 13 <> 0 AND k % 23 <> 0 AS has_end,
    CASE WHEN k % 19 = 0 THEN '.' ELSE '' END || CASE WHEN k % 17 = 0 THEN '_L' ELSE 'FL' END || '0_'
      || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '_00000_' || strftime(d, '%d%m%Y') || '.csv' AS file_name
  FROM days),
"""
    + _VERDICT
    + _CELLS
    + _JUDGED.replace("WHERE error IS NULL", "WHERE error IS NULL AND NOT is_empty")
)
_FLAT_VERDICTS = """
  SELECT DISTINCT file_name, CASE WHEN error IS NOT NULL THEN error
    WHEN is_empty THEN 'File ' || file_name || ' is not valid: header has no # column' END AS error
  FROM verdicts
"""

_JSON = (
    "WITH "
    + _CELLS
    + """
lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, TRY_CAST(start_text AS DATE) AS sd,
    TRY_CAST(end_text AS DATE) AS ed, TRY_CAST(duration_text AS BIGINT) AS duration,
    CASE WHEN l_partkey % 29 <> 0 AND l_partkey % 19 <> 0 THEN l_extendedprice END AS price,
    '{"id":' || (l_orderkey * 10 + l_linenumber) || ',"startDate":"' || start_text
      || '","endDate":"' || end_text || '"'
      || coalesce(',"duration":' || TRY_CAST(duration_text AS BIGINT), '')
      || CASE WHEN l_partkey % 29 = 0 THEN ''
        WHEN l_partkey % 19 = 0 THEN ',"price":"' || l_extendedprice || '"'
        ELSE ',"price":' || l_extendedprice END || '}' AS value
  FROM cells)
"""
)
_JSON_ROWS = (
    _JSON
    + """SELECT id, CAST(sd AS VARCHAR) AS "startDate", CAST(ed AS VARCHAR) AS "endDate", duration,
price FROM lines
WHERE sd IS NOT NULL AND ed IS NOT NULL AND duration IS NOT NULL AND price IS NOT NULL"""
)

_WITH_TABLE = (
    f"SELECT {_STORED}, CASE WHEN \"isMoreYear\" THEN 'longSubscription' ELSE 'subscription' END"
    ' AS "table" FROM items'
)


def _end(prelude: str) -> str:
    """A WITH list without its last comma."""
    return prelude.rstrip().rstrip(",") + "\n"


_FILES_ONLY = _end("WITH " + _FILES + _VERDICT)

ORACLE: dict[str, str] = {
    "bucket_totals": _ROWS
    + _ITEMS
    + 'SELECT "isMoreYear", count(*) AS n, CAST(sum(CAST(price AS DECIMAL(20, 2))) AS DOUBLE) AS price FROM items GROUP BY 1',
    "file_check": _FILES_ONLY + "SELECT file_name, error FROM verdicts",
    "files_passed": _FILES_ONLY + "SELECT file_name FROM verdicts WHERE error IS NULL",
    "file_rejects": _FILES_ONLY + "SELECT file_name, error FROM verdicts WHERE error IS NOT NULL",
    "mask_fields": _FILES_ONLY
    + """SELECT file_name,
  CASE WHEN name_ok THEN split_part(file_name, '_', 1) END AS product,
  CASE WHEN name_ok THEN split_part(file_name, '_', 2) END AS client,
  CASE WHEN name_ok THEN split_part(file_name, '_', 3) END AS "user",
  CASE WHEN name_ok THEN CAST(file_date AS VARCHAR) END AS file_date
FROM verdicts""",
    "header_check": _end(_CSV) + "SELECT file_name, id_text, headers_ok FROM records",
    "end_markers": _FILES_ONLY
    + "SELECT file_name FROM verdicts WHERE error IS NULL AND has_end",
    "assemble_rows": _end(_ROWS) + f"SELECT {_ROW} FROM packets",
    "row_rejects": _end(_ROWS)
    + """SELECT file_name, id_text, start_text, end_text, duration_text, price_text, reason
FROM reasoned WHERE reason IS NOT NULL""",
    "row_check": _end(_ROWS) + f"SELECT {_ROW}, is_valid FROM packets",
    "row_check_strict": _end(_ROWS)
    + f"SELECT {_ROW}, is_valid AND sd <= file_date AS is_valid FROM packets",
    "good_rows": _end(_ROWS) + f"SELECT {_ROW} FROM packets WHERE is_valid",
    "row_failures": _end(_ROWS)
    + f"SELECT {_ROW}, {_failure()} AS error FROM packets WHERE NOT is_valid",
    "file_success": _end(_STATUSES) + 'SELECT file_name, "countRecord" FROM success',
    "status_union": _end(_ROWS)
    + f"SELECT {_ROW}, {_failure()} AS error, FALSE AS is_valid FROM packets WHERE NOT is_valid "
    f"UNION ALL SELECT {_ROW}, NULL AS error, TRUE AS is_valid FROM packets WHERE is_valid",
    "stage_table": _end(_ROWS)
    + f"SELECT {_ROW}, is_valid, CASE WHEN NOT is_valid THEN {_failure()} END AS error FROM packets",
    "status_counts": _end(_STATUSES) + "SELECT file_name, seen, good FROM counts",
    "reconcile": _end(_ARRIVED) + 'SELECT file_name, "countGoodRecords" FROM statuses',
    "held_counts": _end(_STATUSES) + "SELECT file_name, held FROM held",
    "gate": _end(_ARRIVED)
    + f"SELECT {_ROW}, is_complete FROM packets JOIN release USING (file_name) WHERE is_valid",
    "bucket_lists": _ROWS
    + _ITEMS
    + """SELECT file_name, "isMoreYear", 0 AS part, 1 AS parts, count(*) AS n,
  string_agg(id || ':' || "startDate" || ':' || "endDate" || ':' || duration || ':'
    || format('{:.2f}', price), ',' ORDER BY id, "startDate", "endDate", duration, price) AS items
FROM items GROUP BY file_name, "isMoreYear\"""",
    "list_rows": _ROWS + _ITEMS + f'SELECT "isMoreYear", id, {_STORED} FROM items',
    "store_rows_short": _ROWS + _ITEMS + f'SELECT {_STORED} FROM items WHERE NOT "isMoreYear"',
    "store_rows_long": _ROWS + _ITEMS + f'SELECT {_STORED} FROM items WHERE "isMoreYear"',
    "csv_files": _end(_CSV + _PER_FILE)
    + """SELECT file_name, error, "countRecord", "countGoodRecords"
FROM (SELECT DISTINCT file_name, error FROM verdicts)
LEFT JOIN success USING (file_name) LEFT JOIN statuses USING (file_name)""",
    "flat_files": _end(_FLAT + _PER_FILE)
    + f"""SELECT file_name, error, "countRecord", "countGoodRecords", rejected
FROM ({_FLAT_VERDICTS})
LEFT JOIN success USING (file_name) LEFT JOIN statuses USING (file_name)
LEFT JOIN (SELECT file_name, count(*) AS rejected FROM reasoned WHERE reason IS NOT NULL GROUP BY 1) USING (file_name)""",
    "ordered_lists": _end(_FLAT)
    + """SELECT file_name, duration > 365 AS "isMoreYear", 0 AS part, 1 AS parts, count(*) AS n,
  string_agg(id || ':' || CAST(sd - DATE '1970-01-01' AS BIGINT) || ':' || CAST(ed - DATE '1970-01-01' AS BIGINT)
    || ':' || duration || ':' || format('{:.2f}', price), ',' ORDER BY l_orderkey, l_linenumber) AS items
FROM packets WHERE is_valid GROUP BY 1, 2""",
    "csv_rows": _end(_CSV) + f"SELECT {_ROW}, is_valid FROM packets",
    "csv_row_rejects": _end(_CSV)
    + "SELECT file_name, reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY 1, 2",
    "csv_stored": _CSV + _ITEMS + _WITH_TABLE,
    "json_rows": _JSON_ROWS,
    "json_rejects": _JSON
    + "SELECT id, value FROM lines "
    "WHERE sd IS NULL OR ed IS NULL OR duration IS NULL OR price IS NULL",
    "stream_reconcile": _end(_ARRIVED) + 'SELECT file_name, "countGoodRecords" FROM met',
    # Even rows come first; if they alone are the number, odd rows start anew.
    "stream_gate": _end(_ARRIVED)
    + f"""SELECT {_ROW}, CASE WHEN even_complete AND held_even > 0 THEN id % 2 = 0 ELSE is_complete END
  AS is_complete
FROM packets JOIN release USING (file_name) WHERE is_valid""",
    # A file's rows in the order of arrival and then of their values; complete are as many as
    # the status says, if there are as many.
    "stream_gate_rows": _end(_ARRIVED)
    + f"""SELECT {_ROW}, place <= "countGoodRecords" AND held >= "countGoodRecords" AS is_complete
FROM (
  SELECT p.*, coalesce(s."countGoodRecords", 0) AS "countGoodRecords", h.held, row_number() OVER (
    PARTITION BY file_name ORDER BY id % 2, id, sd, ed, duration, price) AS place
  FROM packets p JOIN held h USING (file_name) LEFT JOIN statuses s USING (file_name) WHERE is_valid)""",
    "stream_idle_release": _end(_ROWS)
    + f"SELECT {_ROW}, FALSE AS is_complete FROM packets WHERE is_valid",
    "stream_late_rows": _end(_ARRIVED)
    + f"""SELECT {_ROW}, id % 2 = 0 AND even_complete AS is_complete
FROM packets JOIN release USING (file_name) WHERE is_valid""",
    "stream_store": _ROWS + _ITEMS + _WITH_TABLE,
    "stream_json": _JSON_ROWS,
    "stream_files": _end(_CSV + _PER_FILE)
    + f"SELECT {_ROW}, is_complete FROM packets JOIN release USING (file_name) WHERE is_valid",
    "stream_flat_files": _end(_FLAT + _PER_FILE)
    + f"""SELECT {_ROW}, is_complete, NULL AS error
FROM packets JOIN release USING (file_name) WHERE is_valid
UNION ALL SELECT file_name, NULL, NULL, NULL, NULL, NULL, NULL, error FROM ({_FLAT_VERDICTS}) WHERE error IS NOT NULL""",
}

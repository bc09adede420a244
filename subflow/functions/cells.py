"""From one text line to named text cells, and from text cells to values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from subflow.schemas import COLUMNS, ID

# After a comma: a quoted cell (doubled quotes and backslash escapes inside), or
# everything up to the next comma.
_CELL = r'(?s),("[^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+"(?=,|$)|[^,]*+)'

# Four digits for the year, or a sign and as many as it takes.
_ISO_DATE = r"^(\d{4}|\+\d{5,6}|-\d{4,6})-\d{2}-\d{2}$"

# A word where a number should be, unless it is NaN or Infinity in that spelling.
_WRONG_WORD = r"^\s*[+-]?(?!(NaN|Infinity)\s*$)[A-Za-z]"


def _unquote(cell: Column) -> Column:
    inner = cell.substr(F.lit(2), F.length(cell) - 2)
    plain = F.regexp_replace(inner, r'(?s)"(")|\\(.)', "$1$2")
    return F.when(cell.rlike(r'(?s)^".*"$') & (F.length(cell) >= 2), plain).otherwise(cell)


def split_cells(line: Column) -> Column:
    """Comma-separated cells of a line; quoted cells may hold commas.

    A quoted cell cannot run over a line break: the text source has split the
    line before it gets here, and such a row ends in the rejects.
    """
    with_comma = F.concat(F.lit(","), line)
    quoted = F.transform(F.regexp_extract_all(with_comma, F.lit(_CELL), 1), _unquote)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def layouts(header: Column) -> Column:
    """Where the five columns are in a file, by the cell count of a row.

    A row of n cells is keyed by the first n header cells, a later cell with the
    same name wins, and the row counts only if its keys are exactly the five
    columns. Entry n holds the five positions (from 1), or null where the first n
    header cells are not exactly those names. Past the first unknown name no row
    can be right, so the array ends there; null if it would be empty.
    """
    known = F.transform(header, lambda name: name.isin(*COLUMNS))
    first_unknown = F.array_position(known, F.lit(False)).cast("int")
    usable = F.when(first_unknown > 0, first_unknown - 1).otherwise(F.size(header))

    def layout(n: Column) -> Column:
        backwards = F.reverse(F.slice(header, F.lit(1), n))
        last = [
            (n + 1 - F.array_position(backwards, F.lit(name)).cast("int")).alias(f"at{i}")
            for i, name in enumerate(COLUMNS)
        ]
        complete = F.size(F.array_distinct(backwards)) == len(COLUMNS)
        return F.when(complete, F.struct(*last))

    return F.when(usable > 0, F.transform(F.sequence(F.lit(1), usable), layout))


def id_positions(header: Column) -> Column:
    """Positions of the # column, in rising order; empty if there is none."""
    numbered = F.transform(header, lambda name, i: F.when(name == ID, i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def cells_by_header(cells: Column, header_size: Column, at: Column, id_at: Column) -> list[Column]:
    """The record columns of a row, given its file's header size, layouts and # positions."""
    n = F.least(F.size(cells), header_size)
    layout = F.get(at, n - 1)
    id_pos = F.when(F.size(id_at) == 1, F.get(id_at, F.lit(0))).otherwise(
        F.array_max(F.filter(id_at, lambda i: i <= n))
    )
    named = [F.get(cells, layout[f"at{i}"] - 1) for i in range(1, len(COLUMNS))]
    return [
        layout.isNotNull().alias("headers_ok"),
        F.when(id_pos <= n, F.get(cells, id_pos - 1)).alias("id_text"),
        *[
            c.alias(name)
            for c, name in zip(named, ("start_text", "end_text", "duration_text", "price_text"))
        ],
    ]


# Most cells have the plain form of their kind, which comparisons tell at a fraction of what a
# regular expression costs; the others go through that.


def _digit_first(text: Column) -> Column:
    return (text >= "0") & (text < ":")


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd and nothing shorter or longer; null for a day that does not exist."""
    # With a digit at both ends and dashes there, a cast takes ten characters as this form only.
    dashes = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    plain = (F.length(text) == 10) & dashes & _digit_first(text) & _digit_first(F.substring(text, 10, 1))
    return F.when(plain | text.rlike(_ISO_DATE), text.try_cast("date"))


def whole_number(text: Column) -> Column:
    """Sign and digits only (a cast alone would trim spaces); null beyond 64 bits."""
    number = text.try_cast("bigint")
    # A number that is written as Spark writes it has neither spaces nor a fraction.
    plain = _digit_first(text) & (number.cast("string") == text)
    return F.when(plain | text.rlike(r"^[+-]?\d+$"), number)


def decimal_number(text: Column) -> Column:
    """A double; NaN and Infinity only in that spelling."""
    plain = _digit_first(text) | ((text >= "-0") & (text < "-:"))
    return F.when(plain | ~text.rlike(_WRONG_WORD), text.try_cast("double"))


def once(**columns: Column) -> Column:
    """Columns that are computed once per row, however often later steps use them.

    Catalyst copies a projected expression into every filter that names it, and the
    rules name a parsed date several times; it does not copy out of a generator. For
    use in ``select``.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def epoch_day(date: Column) -> Column:
    return F.unix_date(date).cast("bigint")

"""Records of delimited files by byte ranges, where quoted cells may hold line breaks.

A line break inside quotes doesn't end a record, and whether a byte is inside quotes
depends on all bytes before it. A file is cut into ranges of fixed size, and no task needs
another's range: a first pass tells for each range of a file that has several, and for each
state that it may begin in, the state that it ends in. From these few numbers every range's
true first state follows. A second pass then cuts records: a range's task puts out those
that begin behind a line end within it (the first one also the file's first record), and
reads on for the end of its last. Bytes of a range without quotes are cut in numpy.

States: at the start of a cell, within a plain cell, within quotes, behind a quote that
closes them unless it is doubled, and behind a backslash within quotes. A quote opens only
at the start of a cell. ``\\n``, ``\\r`` and both together end a record.

A record is read up to ``MAX_RECORD`` bytes; what is longer, as after a quote that nobody
closes, is cut there, and its row ends in the rejects. Bytes that are no UTF-8 become
replacement characters. Only a file's first bytes are read for its header.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subflow.sources.discovery import file_store

RANGE_BYTES = 32 * 1024 * 1024
# Bytes that one task reads, about.
TASK_BYTES = 64 * 1024 * 1024
MAX_RECORD = 1024 * 1024
AHEAD = 64 * 1024
RECORDS_AT_ONCE = 20_000
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

START, PLAIN, QUOTED, CLOSING, ESCAPED = range(5)

# What stands within quotes; it ends before a quote, a lone backslash or the last byte.
_within = re.compile(rb'(?:[^"\\]|""|\\.)*+', re.S).match


def quoted_spans(data: bytes, state: int) -> tuple[list[tuple[int, int]], int]:
    """The spans of ``data`` that are within quotes (end exclusive), and the state it ends in."""
    spans, at, size = [], 0, len(data)
    if not size:
        return spans, state
    if state == CLOSING:
        state = QUOTED if data[0] == 34 else PLAIN
        at = int(state == QUOTED)
    elif state == ESCAPED:
        state, at = QUOTED, 1
    opened = 0
    while True:
        if state == QUOTED:
            end = _within(data, at).end()
            if end == size:
                return [*spans, (opened, size)], QUOTED
            if data[end] == 92:  # a backslash, the last byte
                return [*spans, (opened, size)], ESCAPED
            spans.append((opened, end + 1))
            if end + 1 == size:
                return spans, CLOSING
            state, at = PLAIN, end + 1
        found = data.find(b'"', at)
        while found > 0 and data[found - 1] not in b",\n\r":
            found = data.find(b'"', found + 1)
        if found == 0 and state != START:
            found = data.find(b'"', 1)
            while found > 0 and data[found - 1] not in b",\n\r":
                found = data.find(b'"', found + 1)
        if found < 0:
            return spans, START if data[-1] in b",\n\r" else PLAIN
        state, opened, at = QUOTED, found, found + 1


def record_ends(data: bytes, state: int, more: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """For each line end: its first byte, and the next record's; and the state at the end of ``data``.

    ``more`` says that another byte follows, which is the last of ``data``: it only tells
    whether a carriage return stands alone.
    """
    body = data[:-1] if more else data
    spans, end_state = quoted_spans(body, state)
    raw = np.frombuffer(data, np.uint8)
    feeds, returns = np.flatnonzero(raw[: len(body)] == 10), np.flatnonzero(raw[: len(body)] == 13)
    if len(returns):
        last = returns + 1 == len(raw)
        pairs = ~last & (raw[np.minimum(returns + 1, len(raw) - 1)] == 10)
        lone = returns[~pairs]
        after_return = (feeds > 0) & (raw[np.maximum(feeds - 1, 0)] == 13)
        first = np.concatenate((feeds - after_return, lone))
        next_ = np.concatenate((feeds + 1, lone + 1))
        order = np.argsort(next_)
        first, next_ = first[order], next_[order]
    else:
        first, next_ = feeds, feeds + 1
    if spans:
        begins, ends = np.array(spans).T
        span = np.searchsorted(begins, next_ - 1, "right") - 1
        outside = (span < 0) | (next_ - 1 >= ends[np.maximum(span, 0)])
        first, next_ = first[outside], next_[outside]
    return first, next_, end_state


@lru_cache(maxsize=8)
def _store(path: str) -> pafs.FileSystem:
    return file_store(path)[0]


class Bytes:
    """Ranged reads of one file."""

    def __init__(self, store: str, path: str) -> None:
        self.file = _store(store).open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""

    def __enter__(self) -> "Bytes":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def first_state(file: Bytes) -> tuple[int, int]:
    """Where a file's first cell begins, behind a byte order mark, and the state there."""
    return len(BYTE_ORDER_MARK) if file.read(0, 3) == BYTE_ORDER_MARK else 0, START


def whole_record(file: Bytes, begun: bytes, at: int, state: int) -> bytes:
    """A record of which ``begun`` has been read, up to ``at``."""
    parts, held = [begun], len(begun)
    while at < file.size and held < MAX_RECORD:
        end = min(at + AHEAD, file.size)
        more = end < file.size
        data = file.read(at, end + more)
        first, _, state = record_ends(data, state, more)
        body = data[: end - at]
        if len(first):
            parts.append(body[: first[0]])
            record = b"".join(parts)
            # The carriage return of a line end that is cut in two.
            is_cut = first[0] == 0 and data[0] == 10 and record.endswith(b"\r")
            return record[:-1] if is_cut else record
        parts.append(body)
        held += len(body)
        at = end
    return b"".join(parts)


def first_record(file: Bytes) -> str | None:
    """A file's first record; null for an empty file."""
    if not file.size:
        return None
    skip, state = first_state(file)
    return whole_record(file, file.read(0, skip), skip, state)[:MAX_RECORD].decode("utf-8", "replace")


def end_states(data: bytes) -> list[int]:
    """The state that ``data`` ends in, for each state that it may begin in."""
    return [quoted_spans(data, state)[1] for state in range(5)]


def records_of(file: Bytes, start: int, end: int, state: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Records that begin behind a line end in a range, with the byte they begin at."""
    skip = 0
    if start == 0:
        skip, state = first_state(file)
    end = min(end, file.size)
    more = end < file.size
    data = file.read(start, end + more)
    first, next_, state = record_ends(data[skip:], state, more)
    body = data[: end - start]
    first, next_ = (first + skip).tolist(), (next_ + skip).tolist()
    begins = ([0] if start == 0 and file.size else []) + next_
    stops = first if start == 0 else first[1:]
    for low in range(0, len(stops), RECORDS_AT_ONCE):
        high = min(low + RECORDS_AT_ONCE, len(stops))
        some = zip(begins[low:high], stops[low:high], strict=True)
        yield [body[a:b][:MAX_RECORD] for a, b in some], [start + a for a in begins[low:high]]
    if len(begins) > len(stops) and start + begins[-1] < file.size:
        last = whole_record(file, body[begins[-1] :], start + len(body), state)
        yield [last[:MAX_RECORD]], [start + begins[-1]]


def as_texts(records: list[bytes]) -> pa.Array:
    raw = pa.array(records, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in records], pa.string())


def _spread(files: DataFrame, total: int, *by: str) -> DataFrame:
    """Rows dealt to tasks of about ``TASK_BYTES``, and at least as many as the cluster's cores."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, -(-total // TASK_BYTES)), *by)


def first_records(files: DataFrame) -> DataFrame:
    """Files (store, file_path, ...) with ``header_line``, the first record, from their first bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for store, path in zip(batch["store"], batch["file_path"], strict=True):
                with Bytes(store, path) as file:
                    lines.append(first_record(file))
            yield batch.assign(header_line=pd.Series(lines, dtype=object, index=batch.index))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return _spread(files, 0, "file_path").mapInPandas(read, f"{columns}, header_line string")


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``store, file_path, start, end, state``: the ranges of files (store, file_path, length) and their first states.

    Only files of several ranges are read for that.
    """
    n = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)).cast("int")
    cut = files.select("store", "file_path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("number"), n.alias("n"))
    start = F.col("number").cast("bigint") * range_bytes
    cut = cut.select("store", "file_path", start.alias("start"), F.least(start + range_bytes, "length").alias("end"), "n")
    columns = "store string, file_path string, start bigint, end bigint"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = []
            for row in batch.itertuples():
                with Bytes(row.store, row.file_path) as file:
                    skip = first_state(file)[0] if row.start == 0 else 0
                    states.append(end_states(file.read(row.start + skip, row.end)))
            yield batch[["store", "file_path", "start", "end"]].assign(states=states)

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        state, states = START, []
        for ends in group["states"]:
            states.append(state)
            state = int(ends[state])
        return group[["store", "file_path", "start", "end"]].assign(state=states)

    # A line of five small numbers per range of one file comes together, no text.
    several = cut.filter("n > 1").repartition("file_path", "start")
    scanned = several.mapInPandas(scan, f"{columns}, states array<int>")
    known = scanned.groupBy("store", "file_path").applyInPandas(compose, f"{columns}, state int")
    alone = cut.filter("n = 1").select("store", "file_path", "start", "end", F.lit(START).alias("state"))
    return alone.unionByName(known)


def read_ranges(ranges: DataFrame, total: int) -> DataFrame:
    """``file_path, at, value``: the records of ranges, and the byte of its file where each begins."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Bytes(row["store"], row["file_path"]) as file:
                    for records, at in records_of(file, row["start"], row["end"], row["state"]):
                        path = pa.array([row["file_path"]] * len(records), pa.string())
                        columns = {"file_path": path, "at": pa.array(at, pa.int64()), "value": as_texts(records)}
                        yield pa.RecordBatch.from_pydict(columns)

    dealt = _spread(ranges, total, "file_path", "start")
    return dealt.mapInArrow(read, "file_path string, at bigint, value string")

"""Many files under one key of a stream's state, so that a file costs no call on the state.

A processor sees one file at a time and asks for its state, writes it and sets a timer; each
of these is a round trip between Python and the state store, which with millions of files
is nearly all of the time. So files are dealt to ``GROUPS`` groups by a hash of their name,
and a group is the key: its files' numbers are one value, read and written once per
micro-batch, its lists are added to once, and it has one timer, for the file that is idle
first. The processor stays as it is; what it takes for the state is the group in memory.

A group's value is rewritten when one of its files has a line, so a line costs a group at
most: a ``GROUPS``-th of the open files. Lists are read only when a file's rows leave.
"""

import json
import sys
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers get the processor with the query and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The number must stay the same as long as a checkpoint is used.
GROUPS = 4096
# Lines that come out at once.
LINES_AT_ONCE = 10_000
# Stands for null in columns that pandas would otherwise turn into doubles; counts and
# arrivals are never below 0.
NONE = -1


class _Files:
    """The numbers of a group's files, and of the file that is at hand."""

    def __init__(self, value: str | None) -> None:
        self.by_name = {name: numbers for name, *numbers in json.loads(value)} if value else {}
        self.name = None

    def get(self):
        return self.by_name.get(self.name)

    def update(self, numbers: tuple) -> None:
        self.by_name[self.name] = numbers

    def clear(self) -> None:
        self.by_name.pop(self.name, None)

    def idle_first(self) -> int:
        """When the first of the files was last active; their last number says so."""
        return min(numbers[-1] for numbers in self.by_name.values())

    def idle_since(self, time: int) -> list:
        return [name for name, numbers in self.by_name.items() if numbers[-1] <= time]

    def value(self) -> str:
        return json.dumps([(name, *numbers) for name, numbers in self.by_name.items()])


class _Lists:
    """The lists of a group's files. They are read when one is asked for, else only added to."""

    def __init__(self, stored, files: _Files) -> None:
        self.stored, self.files = stored, files
        self.all: dict | None = None
        self.new: dict = {}

    def _read(self) -> dict:
        if self.all is None:
            self.all = {}
            for (some,) in self.stored.get():
                self._add(self.all, json.loads(some))
            self._add(self.all, self.new.items())
        return self.all

    @staticmethod
    def _add(to: dict, some) -> None:
        for name, items in some:
            to.setdefault(name, []).extend(map(tuple, items))

    def get(self) -> Iterator[tuple]:
        return iter(self._read().get(self.files.name, ()))

    def appendList(self, items: list[tuple]) -> None:
        to = self.new if self.all is None else self.all
        to.setdefault(self.files.name, []).extend(items)

    def clear(self) -> None:
        self._read().pop(self.files.name, None)

    def write(self) -> None:
        if self.all is None:
            if self.new:
                self.stored.appendValue((json.dumps(list(self.new.items())),))
        elif self.all:
            self.stored.put([(json.dumps(list(self.all.items())),)])
        else:
            self.stored.clear()


class _Group:
    """A group as the handle of a processor of one file at a time, which makes its state here."""

    def __init__(self, value: str | None, lists) -> None:
        self.files = _Files(value)
        self.lists = _Lists(lists, self.files)

    def getValueState(self, *_) -> _Files:
        return self.files

    def getListState(self, *_) -> _Lists:
        return self.lists

    def registerTimer(self, _) -> None:
        """A group's timer follows from its files."""

    deleteTimer = registerTimer


class Together(StatefulProcessor):
    """Runs a processor of single files over the files of a group.

    The processor has one value per file, whose last number is the time of its last line,
    and at most one list.
    """

    def __init__(self, processor: StatefulProcessor, columns: list[str], out: T.StructType) -> None:
        self.processor, self.columns, self.out = processor, columns, out.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("files", "files string, timer bigint")
        self.lists = handle.getListState("lists", "items string")
        self.line = namedtuple("Line", self.columns)

    def _open(self) -> tuple[_Group, int | None]:
        value, timer = self.value.get() or (None, None)
        group = _Group(value, self.lists)
        self.processor.init(group)
        return group, timer

    def _close(self, group: _Group, before: int | None) -> None:
        group.lists.write()
        idle, open_ = self.processor.idle_ms, bool(group.files.by_name)
        timer = group.files.idle_first() + idle if idle and open_ else None
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        if open_:
            self.value.update((group.files.value(), timer))
        else:
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines: dict = {}
        for some in rows:
            values = [some[c].tolist() for c in self.columns]
            values = [[None if v == NONE else v for v in column] for column in values]
            for name, line in zip(some["file_name"].tolist(), map(self.line, *values), strict=True):
                lines.setdefault(name, []).append(line)
        group, timer = self._open()

        def put_out():
            for name, of_file in lines.items():
                group.files.name = name
                yield from self.processor.handleInputRows((name,), of_file, timerValues)

        yield from self._frames(put_out())
        self._close(group, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        group, timer = self._open()
        now = timerValues.getCurrentProcessingTimeInMs()

        def put_out():
            for name in group.files.idle_since(now - self.processor.idle_ms):
                group.files.name = name
                yield from self.processor.handleExpiredTimer((name,), timerValues, expiredTimerInfo)

        yield from self._frames(put_out())
        self._close(group, timer)

    def _frames(self, found) -> Iterator[pd.DataFrame]:
        # All of a group's files are seen before a line goes out: who takes the lines may wait.
        found = list(found)
        for low in range(0, len(found), LINES_AT_ONCE):
            columns = zip(*found[low : low + LINES_AT_ONCE], strict=True)
            yield pd.DataFrame({name: pd.Series(c, dtype=object) for name, c in zip(self.out, columns, strict=True)})

    def close(self) -> None:
        self.processor.close()


def per_file(lines: DataFrame, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    """A processor of single files over a stream of lines: ``file_name``, and whole numbers or nulls."""
    columns = [c for c in lines.columns if c != "file_name"]
    plain = lines.select(
        F.pmod(F.xxhash64("file_name"), F.lit(GROUPS)).cast("int").alias("file_group"),
        "file_name",
        *[F.coalesce(c, F.lit(NONE)).cast("bigint").alias(c) for c in columns],
    )
    return plain.groupBy("file_group").transformWithStateInPandas(
        statefulProcessor=Together(processor, columns, out),
        outputStructType=out,
        outputMode="append",
        timeMode="ProcessingTime" if processor.idle_ms else "none",
    )

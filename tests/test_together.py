"""Files in groups: what comes out is what comes out file by file, with a few calls on the state per group."""

import random

import pandas as pd
import pytest
from pyspark.sql import Row

from subflow.schemas import RECONCILED, RELEASE, RELEASE_CUT
from subflow.streaming.gate import HoldFile
from subflow.streaming.reconcile import ReconcileFile
from subflow.streaming.together import NONE, Together


class Store:
    """A key's state and timers, and the clock; counts the calls on them."""

    def __init__(self):
        self.value, self.items, self.timers, self.now, self.calls = None, [], set(), 0, 0

    def getValueState(self, *_):
        return Cell(self, "value")

    def getListState(self, *_):
        return Cell(self, "items")

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        found = getattr(self.store, self.name)
        return iter(list(found)) if self.name == "items" else found

    def update(self, value):
        self.store.calls += 1
        setattr(self.store, self.name, value)

    put = update

    def appendList(self, new):
        self.store.calls += 1
        self.store.items = [*self.store.items, *new]

    def appendValue(self, new):
        self.appendList([new])

    def clear(self):
        self.update([] if self.name == "items" else None)


def lines_of(pick, files, arrivals):
    """Batches of (time, lines); lines come again, and many files never meet."""
    for n in range(arrivals):
        lines = []
        for name in files:
            if pick.random() < 0.5:
                continue
            good = pick.randrange(4)
            kind = {"countRecord": pick.randrange(6), "seen": 0, "good": 0} if pick.random() < 0.3 else {"countRecord": None, "seen": good, "good": good}
            gate = {"expected": pick.randrange(8), "arrival": None, "held": 0} if pick.random() < 0.3 else {"expected": None, "arrival": n, "held": good + 1}
            lines += [(name, {"arrival": n, **kind}, gate)] * pick.choice([1, 1, 2])
        yield n * 400, lines


@pytest.mark.parametrize(
    "make, out",
    [
        (lambda: HoldFile(1000), RELEASE),
        (lambda: HoldFile(1000, by_row=True), RELEASE_CUT),
        (lambda: ReconcileFile(1000), RECONCILED),
        (lambda: ReconcileFile(None), RECONCILED),
    ],
)
def test_a_group_gives_what_its_files_give(make, out):
    pick, files = random.Random(5), ["ä", 'q"', None, *(f"f{i}" for i in range(30))]
    is_gate = isinstance(make(), HoldFile)
    columns = ["arrival", "expected", "held"] if is_gate else ["arrival", "countRecord", "seen", "good"]
    alone, store = {name: Store() for name in files}, Store()
    batches = [*lines_of(pick, files, 40), (10**6, [])]
    for now, lines in batches:
        lines = [(name, gate if is_gate else counts) for name, counts, gate in lines]
        want, got = [], []
        for name, own in alone.items():
            processor, own.now = make(), now
            processor.init(own)
            rows = [Row(**line) for n, line in lines if n == name]
            if rows:
                want += list(processor.handleInputRows((name,), iter(rows), own))
            for at in sorted(t for t in own.timers if t <= now):
                want += list(processor.handleExpiredTimer((name,), own, None))
                own.timers.discard(at)
        group, store.now = Together(make(), columns, out), now
        group.init(store)
        half = len(lines) // 2
        frames = [
            pd.DataFrame([{"file_name": n, **{c: NONE if line[c] is None else line[c] for c in columns}} for n, line in some])
            for some in (lines[:half], lines[half:])
            if some
        ]
        if frames:
            got += list(group.handleInputRows((1,), iter(frames), store))
        for at in sorted(t for t in store.timers if t <= now):
            got += list(group.handleExpiredTimer((1,), store, None))
            store.timers.discard(at)
        rows = [tuple(r) for frame in got for r in frame[out.fieldNames()].itertuples(index=False)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in out.fieldNames())) for r in want)
    if make().idle_ms:
        assert store.value is None and not store.items and not store.timers


@pytest.mark.parametrize("make, out", [(lambda: HoldFile(1000), RELEASE), (lambda: ReconcileFile(1000), RECONCILED)])
def test_more_files_take_no_more_calls(make, out):
    columns = ["arrival", "expected", "held", "countRecord", "seen", "good"]
    line = {"arrival": 0, "expected": NONE, "held": 1, "countRecord": NONE, "seen": 1, "good": 1}
    calls, found = [], []
    for n in (1, 5000):
        group, store = Together(make(), columns, out), Store()
        group.init(store)
        frame = pd.DataFrame([{"file_name": f"f{i}", **line} for i in range(n)])
        assert list(group.handleInputRows((1,), iter([frame]), store)) == []
        store.now = 5000
        found.append(sum(len(f) for f in group.handleExpiredTimer((1,), store, None)))
        calls.append(store.calls)
    assert calls[0] == calls[1] <= 12 and found == [1, 5000]


def test_lines_of_a_file_are_added_without_reading_its_list():
    """Also in a group, a line costs the same at the thousandth arrival."""
    columns = ["arrival", "expected", "held"]
    group, store = Together(HoldFile(1000), columns, RELEASE), Store()
    group.init(store)
    for arrival in range(1000):
        frame = pd.DataFrame([{"file_name": "f", "arrival": arrival, "expected": NONE, "held": 1}])
        assert list(group.handleInputRows((1,), iter([frame]), store)) == []
    assert len(store.items) == 1000 and len(store.value[0]) < 60
    store.now = 5000
    (frame,) = group.handleExpiredTimer((1,), store, None)
    assert frame["arrivals"][0] == list(range(1000)) and store.items == [] and store.value is None

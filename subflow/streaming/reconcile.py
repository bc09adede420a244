"""Reconciliation on a stream: declared rows against row statuses, per file."""

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from subflow.schemas import RECONCILED
from subflow.streaming.session import with_state_store
from subflow.streaming.together import per_file

# Workers get the processor with the query and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDLE_MS = 3_600_000


class ReconcileFile(StatefulProcessor):
    """Adds up a file's counts until they meet; then says how many rows were good.

    A file's lines come in the order of their arrivals (within one, the declared number
    first), so a line that isn't beyond the last one has been counted. What is kept per
    file are five numbers, however many arrivals it has. The last line is remembered as
    long as the file isn't idle, also when its counts have met, so a line that is read
    again then doesn't count either.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState(
            "counts", "declared bigint, seen bigint, good bigint, line bigint, last_active bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Each call on the state is a round trip, so none is made without need.
        before = self.counts.get()
        declared, seen, good, last, active = before or (None, 0, 0, -1, 0)
        if before and self.idle_ms:
            self.handle.deleteTimer(active + self.idle_ms)
        for row in sorted(rows, key=lambda r: (r.arrival, r.countRecord is None)):
            line = 2 * row.arrival + (row.countRecord is None)
            if line <= last:
                continue
            last = line
            if row.countRecord is not None:
                declared = row.countRecord
                meets = seen == declared
            else:
                # Counted row by row, the number would be met on the way.
                meets = declared is not None and seen < declared <= seen + row.seen
            seen += row.seen
            good += row.good
            if meets:
                yield Row(file_name=key[0], countGoodRecords=good, is_reconciled=True)
                declared, seen, good = None, 0, 0
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        self.counts.update((declared, seen, good, last, now))
        if self.idle_ms:
            self.handle.registerTimer(now + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.counts.get()
        if not before:
            return
        idle_at = before[4] + self.idle_ms
        if timerValues.getCurrentProcessingTimeInMs() < idle_at:
            self.handle.registerTimer(idle_at)
            return
        declared, seen, good = before[:3]
        if declared is not None or seen:
            yield Row(file_name=key[0], countGoodRecords=good, is_reconciled=False)
        self.counts.clear()

    def close(self) -> None:
        pass


def reconcile_stream(progress: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """(file, good rows, is_reconciled) as soon as a file's counts meet, whichever came last.

    Counts are compared after each line of progress. Where one arrival brings more rows
    than are missing, the declared number is met within it, and all its good rows count.
    A file that had more rows than declared before it was declared, or has no number or
    too few rows, is given up after the idle time: it comes out as not reconciled. So the
    state, a few numbers per file, ends for every file. Without an idle time nothing
    is given up; a run over what is there now needs this, as one with timers never ends.
    """
    with_state_store(progress.sparkSession)
    return per_file(progress, ReconcileFile(idle_ms), RECONCILED)
